"""Text operators against brute force, round trips and defined edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kohorta.llm import near_dup, packing, recurrent
from kohorta.llm.common import ngram_hashes
from kohorta.llm.decontaminate import WindowSet, contamination, cut_words, decontaminate
from kohorta.llm.hnsw import nearest
from kohorta.llm.html_text import extract_text, main_text
from kohorta.llm.language import fold, keep_identified, language_id
from kohorta.llm.licenses import PERMITTED, Scanner, evaluate, license_scan, to_rpn
from kohorta.llm.lm import Vocabulary, lm_scores, tail_class
from kohorta.llm.token_files import scan_token_files, token_counts
from kohorta.llm.tokens import WordIds
from kohorta.llm.warc import LoserTree, capture_index, url_key

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, row int, key string, held_out string"


def words(rng, n, pool="abcdefgh"):
    return " ".join("".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", "  \n", "one", "One", "two words", "ééé ßß", "!!! 123"]
    base = [words(rng, 120) for _ in range(8)]
    out += base + base[:3] + [base[0]] * 10
    for b in base:
        for k in range(6):
            w = b.split()
            w[10 * k + 3] = f"changed{k}"
            out.append(" ".join(w[: 120 - 2 * k]))
    out.append(words(rng, 30_000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, "k", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        assert (near_dup.sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64)) < np.uint64(1 << 63) * np.uint64(2) - np.uint64(1)).all()
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = near_dup.sketch(pool[:900]), near_dup.sketch(pool[100:])
    assert abs((a == b).mean() - 0.8) < 0.15


def test_near_duplicates_match_brute_force(docs, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, words=4).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = near_dup.drop_near_duplicates(docs.unionAll(docs), words=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_large_bucket_without_links_ends(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS_A_ROW", 1)
    monkeypatch.setattr(near_dup, "HUBS", 1)
    rng = random.Random(9)
    shared = words(rng, 90)
    rows = [(i, shared + " " + words(rng, 45, "mnop")) for i in range(30)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got)


def test_sieve_and_splits_lose_no_more_than_the_banding():
    near, lines = 0.8, near_dup.BINS // near_dup.ROWS
    banding = (1 - near**near_dup.ROWS) ** lines
    n = near_dup.FINE * near_dup.BINS
    assert sum(math.comb(n, k) * near**k * (1 - near) ** (n - k) for k in range(near_dup.ALIKE)) < banding / 100
    assert (1 - near**near_dup.DEEP_ROWS) ** near_dup.BINS < banding / 100


@pytest.mark.parametrize("shared", [1, 2])
def test_pairs_that_share_one_or_two_bands_of_a_large_bucket(spark, monkeypatch, shared):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dup, "PAIRS_A_ROW", 0)
    rng = random.Random(4)
    texts = []
    for _ in range(7):
        one = words(rng, 100)
        texts += [one, one + " more", one]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = [(i, [*range(1, shared + 1), *range(100 + 40 * i, 130 + 40 * i)]) for i in range(len(texts))]
    texts_of = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    got = near_dup.links(spark.createDataFrame(bands, "node long, bands array<long>"), texts_of, 5, 80).collect()
    assert {r.node: r.root for r in got} == {i: i // 3 * 3 for i in range(len(texts))}


def test_alike_texts_without_links_are_not_confirmed_pair_by_pair(spark, monkeypatch):
    from kohorta.llm.common import shingle_set, space_words

    rng = random.Random(12)
    base, rows = words(rng, 200).split(), []
    for i in range(100):
        own = list(base)
        for k in rng.sample(range(200), 4):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    sets = [shingle_set(space_words(t.encode()), 4) for _, t in rows]
    alike = []
    for a, b in itertools.combinations(range(100), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        alike.append(both / (len(sets[a]) + len(sets[b]) - both))
    assert sum(0.7 < v < 0.8 for v in alike) > 3000
    looked, real = [], near_dup.confirm

    def counted(pairs, *more):
        looked.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(near_dup, "confirm", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    root = list(range(100))
    for (a, b), v in zip(itertools.combinations(range(100), 2), alike, strict=True):
        if v >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert sum(looked[2:]) <= 10  # what the likest partners left is ruled out by the sets


def test_samples_rule_out_no_link_and_tell_whole_sets_exactly(spark):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)

    def drawn(found):
        level = max(0, (len(found) - 1) // near_dup.SAMPLE).bit_length()
        found = np.sort(found)
        return (found[found < (1 << (64 - level))] >> np.uint64(32)).astype(np.uint32), level

    for size in (90, 900, 1030, 4500, 36_000):  # one in nine new: similarity 0.8; 1030 and its part lie in different levels
        one, same, less = pool[:size], pool[size // 9 : size + size // 9], pool[size // 5 : size]
        far = pool[size // 2 : size + size // 2][: 40_000 - size // 2]
        may = near_dup._by_samples([drawn(one)], [drawn(same), drawn(less), drawn(far)], 80)
        assert may(0, np.arange(3)).tolist() == [True, True, False]
    texts = spark.createDataFrame([(1, b"a b c d"), (1, b"a b c d e"), (2, b"a b c d"), (2, b"a  b c d")], "doc_id long, text binary")
    known = {r.node: (r.sample, r.level) for r in near_dup.set_samples(texts, 4).collect()}
    assert known[1][0] is None and len(known[2][0]) == 4 and known[2][1] == 0


def test_batches_of_long_texts_are_bounded_in_bytes(spark, monkeypatch):
    import corpus_pipeline
    from kohorta.session import TEXT_BATCHES

    ((key, most),) = TEXT_BATCHES.items()
    real, before, looked = near_dup.column, spark.conf.get(key, None), spark.sparkContext.accumulator(0)

    def counted(batch, name):
        assert batch.num_rows == 1 or batch.nbytes <= 1.2 * int(most), batch.nbytes
        if name == "text_a":
            looked.add(batch.num_rows)
        return real(batch, name)

    monkeypatch.setattr(near_dup, "column", counted)
    rng = random.Random(6)
    base = [words(rng, 30_000) for _ in range(10)]
    rows = [(i, f"{base[i % 10]} end{i}") for i in range(300)]  # about 30 MB, and twice that where pairs are confirmed
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near_dup.near_duplicates(docs, words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 10 for i in range(300)}
    assert looked.value >= 290
    assert spark.conf.get(key, None) == before
    try:
        corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "")
        assert int(spark.conf.get(key)) <= int(most)
    finally:
        if before is None:
            spark.conf.unset(key)


def test_contamination_matches_brute_force_in_one_or_more_blocks(spark, docs, texts):
    items = [("a", " ".join(texts[8].split()[5:40])), ("b", "ONE"), ("c", None), (None, "two words"), ("d", "ééé, ßß")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: chr(c + 32) for c in range(65, 91)}
    split = lambda t: rule.findall((t or "").translate(low))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for name, text in items:
            x = split(text)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(name)
        want[i] = (len(w), len(hit), len(found - {None}))
    for block in (200_000, 7):
        got = contamination(docs, bench, block=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == want
    left = decontaminate(docs, bench, block=7)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, x in want.items() if not x[1]]
    assert left.columns == docs.columns


def test_cutting_spans():
    text = b"Keep this. Cut, THESE words! and keep"
    assert cut_words(text, np.array([0, 0, 1, 1, 1, 0, 0], bool)) == b"Keep this. ! and keep"
    assert not WindowSet([]).scan([b"a"])[0].any()


@pytest.mark.parametrize(
    ("text", "labels", "value"),
    [
        ("mit or gpl-3.0-only", {"mit", "gpl-3"}, True),
        ("mit and gpl-3.0-only", {"mit", "gpl-3"}, False),
        ("gpl-2.0-only with classpath-exception-2.0 and mit", {"gpl-2", "mit"}, True),
        ("(mit or gpl-2.0) and cc-by-nc-4.0", {"mit", "gpl-2", "cc-by-nc"}, False),
        ("mit or gpl-2.0 and cc-by-nc-4.0", {"mit", "gpl-2", "cc-by-nc"}, True),
        ("((mit) and", {"mit"}, True),
        ("mit\nor gpl-3", {"mit"}, True),
        ("and mit", set(), None),
        ("mitre-1.0", set(), False),
        ("mit or mitre-1.0", {"mit"}, True),
        ("mit and then some words", {"mit"}, True),
        ("see below", set(), None),
        ("gpl-20 and lgpl-2.1+", {"lgpl"}, False),
        ("isc and zlib", {"isc", "zlib"}, False),
    ],
)
def test_licence_expressions(text, labels, value):
    assert evaluate(to_rpn(text.encode(), 0)) == (labels, value)


def test_licence_places():
    row = Scanner(PERMITTED).scan(b"x Under the MIT license; Apache License, Version 2 (cc-by-nc) under THE mit license")
    assert row[:6] == (16, 4, 1, 12, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit")


def test_html():
    page = """<head><title>t</title></head><nav><p>Menu of links that is long enough to look like text of a page</p></nav>
    <article><h1>Title &amp; more</h1><script>var x="</p><p>no";</script><p class="ad">Buy</p><p>First   line<b> of</b> text.
    <p>Short.<br>After</p><div class="comments"><p>Reader says</p></div></article><footer>end</footer>"""
    assert main_text(page) == "Title & more\nFirst line of text.\nShort.\nAfter"
    long = "words in a row that make a paragraph of some length, again and again. " * 3
    plain = f"<body><div class=menu><a href=1>a</a></div><p>{long}</p><p>Yes.</p><p>{long}</p></body>"
    assert main_text(plain) == f"{long.strip()}\nYes.\n{long.strip()}"
    assert main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("a < b") == "a < b"


def test_loser_tree_merges():
    rng = random.Random(2)
    runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(7)]
    assert list(LoserTree([[(x, x) for x in r] for r in runs])) == sorted(sum(runs, []))
    assert list(LoserTree([])) == []


def test_warc_round_trip(spark):
    assert url_key("https://www.B.example.com:80/X?q=1#f") == "com,example,b)/x?q=1"
    rows = [(i, f"http://h{i % 3}.example.com/a\r\n{i}", "é\r\n\r\nWARC/1.1 " * 12 if i % 2 else "short", "x") for i in range(20)]
    rows += [(None, None, None, "x"), (50, "http://[bad", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = capture_index(pages, archive_mb=1).collect()
    assert [r.urlkey for r in got] == sorted(r.urlkey for r in got)
    by = {r.page_id: r for r in got}
    assert len(got) == 22 and by[1].record_type == "response" and by[None].payload_bytes == 0
    assert all(by[i].record_type == "revisit" and by[i].refers_to == 1 for i in range(3, 20, 2))
    assert all(by[i].record_type == "response" and by[i].refers_to is None for i in range(0, 20, 2))


def test_tokens_packing_and_files_round_trip(spark, docs, texts):
    model = WordIds(VOCABULARY).model
    want = {i: model.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    pieces = packing.pack(docs, VOCABULARY, length=64).collect()
    whole, sequences = {i: {} for i in want}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.doc_tokens == len(want[p.doc_id]) + 1
        whole[p.doc_id][p.start] = ids
        sequences.setdefault(p.sequence_id, {})[p.offset] = p.length
    for i, parts in whole.items():
        assert sum((parts[k] for k in sorted(parts)), []) == [*want[i], 1]
    sizes = []
    for parts in sequences.values():
        end = 0
        for offset in sorted(parts):
            assert offset == end
            end += parts[offset]
        sizes.append(end)
    assert sorted(sequences) == list(range(len(sequences))) and sum(s < 64 for s in sizes) <= 1
    counts = token_counts(docs, VOCABULARY).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(x) for i, x in want.items()}
    odd = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text")).unionAll(docs.selectExpr("cast(null as long)", "text"))
    counts = Counter((r.doc_id, r.n_tokens) for r in token_counts(odd, VOCABULARY).collect())
    expected = Counter({(i, len(x)): 2 for i, x in want.items()})
    for x in want.values():
        expected[None, len(x)] += 1
    assert counts == expected


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(4)
    ids = [rng.choice([1, 5, 256, 65537]) for _ in range(997)]
    (tmp_path / "file_no=0").mkdir()
    (tmp_path / "file_no=0" / "part").write_bytes(np.array(ids, "<u4").tobytes())
    want, at = [], 0
    for k, x in enumerate(ids):
        if x == 1:
            want.append((k - at, at, True))
            at = k + 1
    if at < len(ids):
        want.append((len(ids) - at, at, False))
    for block in (3, 64, 5000):
        got = scan_token_files(spark, str(tmp_path), block=block).orderBy("ordinal").collect()
        assert [(r.n_tokens, r.first_token, r.complete) for r in got] == want
    short = np.array([min(x, 65535) for x in ids], "<u2")
    (tmp_path / "file_no=0" / "part").write_bytes(short.tobytes())
    got = scan_token_files(spark, str(tmp_path), block=64, width=2).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.first_token, r.complete) for r in got] == want


def test_hilbert_is_a_walk_through_all_cells():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    path = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(float)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + k, x[0].tolist(), "x") for k in range(40)]
    rows += [(2000, None, "x"), (2050, [0.0] * 16, "x"), (2100, [float("nan")] * 16, "x"), (2101, [None] * 16, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    from pyspark.sql import functions as F

    got = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0, shard=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [v for _, v, _ in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    ids = np.array([r[0] for r in rows[:-4]])
    unit = np.array([r[1] for r in rows[:-4]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hit = 0
    for q, found in got.items():
        c = unit @ unit[ids == q][0]
        c[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -np.round(c, 12)))[:5]].tolist()) & {v for _, v, _ in found})
    assert hit >= 0.95 * 5 * len(got)


def test_language_by_held_out_accuracy(spark):
    rng = random.Random(8)
    pools = {"en": ["the", "with", "shop"], "de": ["der", "nicht", "schon"], "fr": ["les", "eau", "qui"], "es": ["los", "ción", "muy"]}
    rows = [(i, " ".join(rng.choices(pools[la], k=rng.randint(5, 40))), la, "s", 1, "k", "x") for i in range(400) for la in [list(pools)[i % 4]]]
    rows += [(500, None, "en", "s", 1, "k", "x"), (501, "12 !!", "de", "s", 1, "k", "x"), (502, "der nicht", None, "s", 1, "k", "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in language_id(table, held_out=fold(F.col("doc_id"), 4) == 2).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:400])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "de"
    assert sorted(r.doc_id for r in keep_identified(table).collect()) == [*range(400), 502]


def test_model_gradient():
    rng = np.random.default_rng(5)
    model = recurrent.Model(np.arange(1, 70) + 0.5, 3)
    docs = [rng.integers(0, 69, n).astype(np.uint16) for n in (9, 4, 30, 1)]
    before = model.log_probabilities(docs).sum()
    one = np.array([model.log_probabilities([d])[0] for d in docs])
    assert np.allclose(one.sum(), before, rtol=1e-5)
    for _ in range(30):
        model.train(docs)
    assert model.log_probabilities(docs).sum() > before + 20


def test_head_grows_with_the_vocabulary():
    found = [(b"w%d" % k, 5000 - k) for k in range(4000)]
    tails = Counter(tail_class(w) for w, _ in found)
    mass = {t: (sum(c for w, c in found if tail_class(w) == t), n) for t, n in tails.items()}
    heads = [Vocabulary(sum(c for _, c in found), types, 9, found, mass).head for types in (4000, 2000**2)]
    assert heads == [1024, 2000]
    model = recurrent.Model(np.arange(2028, 0, -1) + 0.5, 3)
    assert len(set(model.class_of[:2000])) == model.head_classes == 46 and model.class_of.max() == model.classes - 1
    share = np.exp([model.log_probabilities([np.array([k], np.uint16)])[0] for k in range(0, 2028)]).sum()
    assert math.isclose(share, 1, rel_tol=1e-4)


def test_lm_scores(spark, docs, texts):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lm_scores(docs, held_out=fold(F.col("doc_id"), 5) == 1).collect()}
    split = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    counts = Counter(w for i, x in enumerate(split) if not held[i] for w in x)
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    for i, x in enumerate(split):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[i], len(x), sum(counts[w] > 0 for w in x))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / total) for w in x), rel_tol=1e-9)
        assert r.train_tokens == sum(counts.values()) and r.score < 0


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    bench = spark.createDataFrame([], "item_id string, text string")
    from pyspark.sql import functions as F

    frames = [
        license_scan(empty), lm_scores(empty), language_id(empty), packing.pack(empty, VOCABULARY), token_counts(empty, VOCABULARY),
        nearest(vectors, F.col("vec_id") % 50 == 0), near_dup.near_duplicates(empty), capture_index(pages),
        contamination(empty, bench), extract_text(pages), decontaminate(empty, bench),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_matches_brute_force(spark, docs, texts, tmp_path):
    """Every stage of run() against a plain version of what it must keep, then the packed pieces id by id."""
    import corpus_pipeline

    item = " ".join(texts[9].split()[20:60])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    sets = {}
    for i in kept:
        w = texts[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in kept}
    for _ in kept:  # least reachable id, spread until nothing changes
        before = dict(root)
        for a, b in itertools.combinations(kept, 2):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    single = [i for i in kept if root[i] == i]
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(item.split()[k : k + 10]) for k in range(31)}
    clean = []
    for i in single:
        w = rule.findall(texts[i].translate({c: chr(c + 32) for c in range(65, 91)}))
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append(i)
    assert len(kept) > len(single) > len(clean) > 5
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, step), want in zip(corpus_pipeline.STAGES, (kept, single, clean), strict=False):
        out = step(spark, stage, str(tmp_path))
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want
        stage = docs.where(docs.doc_id.isin(want))
    model = WordIds(VOCABULARY).model
    pieces, ends = {i: {} for i in clean}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = r
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        ids, at = [*model.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for start in sorted(parts):
            r = parts[start]
            assert start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[start : start + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in ends.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert sum(sum(n for _, n in places) < 2048 for places in ends.values()) <= 1


def test_components_in_one_task_and_in_rounds(spark, rows, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    one = rows(near_dup.components(edges))
    monkeypatch.setattr(near_dup, "ONE_TASK", 0)
    assert rows(near_dup.components(edges)) == one
    assert dict(one)[480] == 400 and all(r <= n for n, r in one)


def test_ngram_hashes_tell_words_apart():
    thue = [b"a"]
    for _ in range(10):
        thue.append(thue[-1] + thue[-1].translate(bytes.maketrans(b"ab", b"ba")))
    other = thue[-1].translate(bytes.maketrans(b"ab", b"ba"))
    one, two = (ngram_hashes([w, b"x", b"y", b"z"], 4) for w in (thue[-1], other))
    assert one != two and len(ngram_hashes([b"a"], 2)) == 0
    many = [b"%d" % (k % 977) for k in range(5000)]
    found = ngram_hashes(many, 3)
    assert len(set(found.tolist())) == 977 and (found[:10] == ngram_hashes(many[:12], 3)).all()
    assert len({ngram_hashes(w, n)[0] for w, n in (([b"a", b"b"], 2), ([b"b", b"a"], 2), ([b"a b"], 1), ([b"ab"], 1))}) == 4
