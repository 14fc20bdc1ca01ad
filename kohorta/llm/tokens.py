"""Token ids by a vocabulary file, with a bounded memory of words."""

from __future__ import annotations

import os
import re

import numpy as np

REMEMBERED = 150_000  # words a worker remembers; others are tokenised each time
LONGEST = 48  # characters of a word that is remembered
GROUP = 64  # texts that are split into words at a time
# Letters and punctuation never share a token, so a blank between them changes no ids and makes words repeat more.
_EDGE = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~]+(?:[\s]|$))")
# Words that the vocabulary's normaliser leaves as they are and that are one piece to it: they go to the merges directly.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level vocabularies name other bytes from 256 on
_BYTE_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts, word by word.

    The tokenizer never joins what white space parts, so a text's ids are those of its words in order.
    Memory holds the first words seen, which are the frequent ones.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.direct = False
        probe = ["straße", "élève", "word", "çñü"]
        plain = self._encode(probe)
        self.direct = True
        self.direct = self._encode(probe) == plain

    def _encode(self, words: list[str]) -> list[bytes]:
        batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        plain = [bool(_PLAIN.fullmatch(w)) for w in words] if self.direct else [False] * len(words)
        rest = iter(batch([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        merge = self.model.model.tokenize
        out = []
        for w, p in zip(words, plain, strict=True):
            if p:
                ids = [k.id for k in merge(w if w.isascii() else "".join([_BYTE_CHAR[b] for b in w.encode()]))]
            else:
                ids = next(rest).ids
            out.append(np.array(ids, "<u4").tobytes())
        return out

    @staticmethod
    def _words(text: bytes) -> list[str]:
        if b"<|" not in text:  # else a special token may stand in it
            text = _EDGE.sub(b" ", text.lower())
        return text.decode("utf-8", "replace").replace("\n", " ").split(" ")

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        return [i for at in range(0, len(texts), GROUP) for i in self._group(texts[at : at + GROUP])]

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [self._words(t) for t in texts]
        known = self.known
        missing = list({w for words in split for w in words if w not in known})
        extra = dict(zip(missing, self._encode(missing), strict=True)) if missing else {}
        out = []
        for words in split:
            if extra:
                out.append(np.frombuffer(b"".join([known[w] if w in known else extra[w] for w in words]), "<u4"))
            else:
                out.append(np.frombuffer(b"".join([known[w] for w in words]), "<u4"))
        for w, ids in extra.items():
            if len(known) >= REMEMBERED:
                break
            if len(w) <= LONGEST:
                known[w] = ids
        return out


def word_ids(path: str) -> WordIds:
    """One per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
