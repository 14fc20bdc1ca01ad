"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are the frequent words and the end mark (``head_size`` at most, ordered by count, ``PER_CLASS`` or more to a
class) and one symbol per tail class.  P(symbol | state) = P(class | state) * P(symbol in class | state); a tail class has one symbol.
The biases start at the corpus's log frequencies, so an untrained model is the unigram model.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HEAD = 1024  # head symbols of a small vocabulary
MOST_HEAD = 1 << 15  # symbols are kept in 16 bits
PER_CLASS = 32
SIZE = 12  # of embeddings and of the state
WINDOW = 32  # steps that gradients flow back
MOST_LANES = 512
RATE = 0.02
BLOCK = 2048  # targets whose class probabilities are held at a time, to stay in cache


def head_size(types: int) -> int:
    """Head symbols for a corpus of ``types`` distinct words: ``HEAD``, or the square root of a large vocabulary."""
    return min(max(HEAD, math.isqrt(types)), MOST_HEAD)


def lanes(docs: list[np.ndarray], most: int = MOST_LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Whole documents laid end to end in lanes of about equal length.

    Returns symbols and starts (steps, lanes), the used length of each lane (longest first) and each document's
    (lane, first step).  A lane never holds part of a document, so its state is carried from window to window.
    """
    sizes = [len(d) for d in docs]
    count = int(max(1, min(most, 2 * sum(sizes) // max(sizes), -(-sum(sizes) // (WINDOW * 8)))))
    heap = [(0, k) for k in range(count)]
    place: list[tuple[int, int]] = [(0, 0)] * len(docs)
    for d in sorted(range(len(docs)), key=lambda d: -sizes[d]):
        load, k = heapq.heappop(heap)
        place[d] = (k, load)
        heapq.heappush(heap, (load + sizes[d], k))
    load = np.zeros(count, np.int64)
    for used, k in heap:
        load[k] = used
    order = np.argsort(-load, kind="stable")
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    symbols = np.zeros((int(load.max()), count), np.int32)
    starts = np.zeros(symbols.shape, bool)
    for d, (k, at) in enumerate(place):
        symbols[at : at + sizes[d], rank[k]] = docs[d]
        starts[at, rank[k]] = True
        place[d] = (int(rank[k]), at)
    return symbols, starts, load[order], place


class Model:
    """Weights in one flat float32 vector, with a named view of each part."""

    def __init__(self, frequency: np.ndarray, end: int, weights: np.ndarray | None = None, tails: int = 28) -> None:
        """``frequency``: smoothed count of every symbol, head symbols first; ``end``: the end mark's symbol."""
        self.end, self.tails = end, tails
        self.symbols = len(frequency)
        self.head = self.symbols - tails
        self.per_class = per_class = max(PER_CLASS, math.isqrt(self.head))
        self.head_classes = -(-self.head // per_class)
        self.classes = self.head_classes + tails
        shapes = {
            "embed": (self.symbols, SIZE), "into": (SIZE, 3 * SIZE), "back": (SIZE, 3 * SIZE), "gate": (3 * SIZE,),
            "to_class": (SIZE, self.classes), "class_bias": (self.classes,),
            "to_word": (self.head_classes, SIZE, per_class), "word_bias": (self.head_classes, per_class),
        }
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
        self.part: dict[str, np.ndarray] = {}
        self.span: dict[str, slice] = {}
        at = 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            self.span[name] = slice(at, at + size)
            self.part[name] = self.flat[at : at + size].reshape(shape)
            at += size
        if weights is not None:
            self.flat[:] = weights
        else:
            self._start(frequency)
        place = np.arange(self.symbols)
        self.class_of = np.where(place < self.head, place // per_class, place - self.head + self.head_classes)

    def _start(self, frequency: np.ndarray) -> None:
        rng = np.random.default_rng(17)
        for name, scale in (("embed", 0.3), ("into", 0.3), ("back", 0.25)):
            self.part[name][:] = rng.normal(0, scale, self.part[name].shape)
        for name in ("to_class", "to_word"):
            self.part[name][:] = rng.normal(0, 0.02, self.part[name].shape)
        self.part["gate"][SIZE : 2 * SIZE] = 1.0  # keep most of the state at first
        words = np.full(self.head_classes * self.per_class, 1e-30)
        words[: self.head] = frequency[: self.head]
        words = words.reshape(self.head_classes, self.per_class)
        self.part["word_bias"][:] = np.maximum(np.log(words), -60)
        self.part["class_bias"][:] = np.log(np.concatenate((words.sum(axis=1), frequency[self.head :])))

    def _steps(self, table: np.ndarray, inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: list | None):
        """States after each step of a window; ``keep`` gathers what the way back needs."""
        back, out = self.part["back"], np.empty((*inputs.shape, SIZE), np.float32)
        for t in range(len(inputs)):
            first = starts[t]
            if first.any():
                state = np.where(first[:, None], np.float32(0), state)
            x, h = table[inputs[t]], state @ back
            gates = np.tanh((x[:, : 2 * SIZE] + h[:, : 2 * SIZE]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = gates[:, :SIZE], gates[:, SIZE:]
            new = np.tanh(x[:, 2 * SIZE :] + r * h[:, 2 * SIZE :])
            after = new + z * (state - new)
            if keep is not None:
                keep.append((state, h[:, 2 * SIZE :], r, z, new, first))
            state = out[t] = after
        return out, state

    def _table(self) -> np.ndarray:
        return self.part["embed"] @ self.part["into"] + self.part["gate"]

    def _output(self, states: np.ndarray, targets: np.ndarray, grad: dict | None):
        """log P of each target, and the gradient at the states."""
        cls = self.class_of[targets]
        log_p = np.empty(len(targets))
        to_state = None if grad is None else np.empty_like(states)
        for lo in range(0, len(targets), BLOCK):
            h, c = states[lo : lo + BLOCK], cls[lo : lo + BLOCK]
            at = np.arange(len(c))
            logits = h @ self.part["to_class"]
            logits += self.part["class_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            own = logits[at, c]
            p = np.exp(logits, out=logits)
            total = p @ np.ones(self.classes, np.float32)
            log_p[lo : lo + BLOCK] = own - np.log(total)
            if grad is not None:
                p /= total[:, None]
                p[at, c] -= 1
                grad["to_class"] += h.T @ p
                grad["class_bias"] += p.sum(axis=0)
                to_state[lo : lo + BLOCK] = p @ self.part["to_class"].T
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.head_classes + 1))
        for c in range(self.head_classes):
            rows = order[edges[c] : edges[c + 1]]
            if not len(rows):
                continue
            h, word = states[rows], targets[rows] - c * self.per_class
            logits = h @ self.part["to_word"][c]
            logits += self.part["word_bias"][c]
            logits -= logits.max(axis=1, keepdims=True)
            k = np.arange(len(rows))
            own = logits[k, word]
            p = np.exp(logits, out=logits)
            total = p @ np.ones(self.per_class, np.float32)
            log_p[rows] += own - np.log(total)
            if grad is not None:
                p /= total[:, None]
                p[k, word] -= 1
                grad["to_word"][c] += h.T @ p
                grad["word_bias"][c] += p.sum(axis=0)
                to_state[rows] += p @ self.part["to_word"][c].T
        return log_p, to_state

    def _inputs(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The symbol before each one; the end mark before a document."""
        before = np.empty_like(symbols)
        before[0] = self.end
        before[1:] = symbols[:-1]
        before[starts] = self.end
        return before

    def log_probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log of each whole document's probability, up to its tail words' shares of their classes."""
        if not docs:
            return np.empty(0)
        symbols, starts, load, place = lanes(docs)
        inputs, table = self._inputs(symbols, starts), self._table()
        owner = np.zeros(symbols.shape, np.int32)
        for d, (k, at) in enumerate(place):
            owner[at : at + len(docs[d]), k] = d
        out = np.zeros(len(docs))
        state = np.zeros((symbols.shape[1], SIZE), np.float32)
        for lo in range(0, len(symbols), WINDOW):
            hi = min(lo + WINDOW, len(symbols))
            n = int((load > lo).sum())
            states, state = self._steps(table, inputs[lo:hi, :n], starts[lo:hi, :n], state[:n], None)
            live = np.arange(lo, hi)[:, None] < load[:n]
            log_p, _ = self._output(states[live], symbols[lo:hi, :n][live], None)
            out += np.bincount(owner[lo:hi, :n][live], log_p, len(docs))
        return out

    def train(self, docs: list[np.ndarray], rate: float = RATE) -> None:
        """One pass over the documents, one Adam step per window."""
        if not docs:
            return
        symbols, starts, load, _ = lanes(docs)
        inputs = self._inputs(symbols, starts)
        state = np.zeros((symbols.shape[1], SIZE), np.float32)
        first, second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        flat = np.zeros_like(self.flat)
        grad = {n: flat[s].reshape(self.part[n].shape) for n, s in self.span.items()}
        for step, lo in enumerate(range(0, len(symbols), WINDOW), 1):
            hi = min(lo + WINDOW, len(symbols))
            n = int((load > lo).sum())
            flat[:] = 0
            keep: list = []
            x = inputs[lo:hi, :n]
            states, state = self._steps(self._table(), x, starts[lo:hi, :n], state[:n], keep)
            live = np.arange(lo, hi)[:, None] < load[:n]
            to_state = np.zeros_like(states)
            _, to_state[live] = self._output(states[live], symbols[lo:hi, :n][live], grad)
            to_table = self._back(keep, to_state, grad)
            rows, wide = x.ravel(), to_table.reshape(-1, 3 * SIZE)
            sums = np.stack([np.bincount(rows, wide[:, c], self.symbols) for c in range(3 * SIZE)], axis=1).astype(np.float32)
            grad["embed"] += sums @ self.part["into"].T
            grad["into"] += self.part["embed"].T @ sums
            grad["gate"] += sums.sum(axis=0)
            flat /= max(1, int(live.sum()))
            norm = float(np.sqrt(flat @ flat))
            if norm > 1:
                flat /= norm
            first += (flat - first) * np.float32(0.1)
            second += (flat * flat - second) * np.float32(0.01)
            speed = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            self.flat -= np.float32(speed) * first / (np.sqrt(second) + np.float32(1e-6))

    def _back(self, keep: list, to_state: np.ndarray, grad: dict) -> np.ndarray:
        """Gradients of a window's steps, last to first; returns those at the gate inputs."""
        back = self.part["back"]
        out = np.empty((*to_state.shape[:2], 3 * SIZE), np.float32)
        carried = np.zeros_like(to_state[0])
        for t in range(len(keep) - 1, -1, -1):
            state, h_new, r, z, new, first = keep[t]
            d = to_state[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * h_new * r * (1 - r)
            out[t, :, :SIZE], out[t, :, SIZE : 2 * SIZE], out[t, :, 2 * SIZE :] = d_r, d_z, d_new
            d_h = np.concatenate((d_r, d_z, d_new * r), axis=1)
            grad["back"] += state.T @ d_h
            carried = d * z + d_h @ back.T
            if first.any():
                carried[first] = 0
        return out
