"""Lexical search, SimHash groups and conversation repair against brute force, with defined edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from kohorta.llm import conversations, lexical, simhash
from kohorta.llm.conversations import Trail, damaged, repair, undamaged
from kohorta.llm.lexical import lexical_search
from kohorta.llm.simhash import build, cross_links, fingerprint, route, self_links, simhash_groups

DOCS = "doc_id long, text string, n long, score string, fp string, rank int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- ranked lexical search -------------------------------------------------------------------------------------------


def ranked(docs, queries, k=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        asked, scored = Counter(words(text)), []
        for i, bag in bags:
            n = sum(bag.values())
            m = 75 + 25 * n * n_docs // total if n else 0
            s = 0
            for t, c in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += c * w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(150)]
    texts += [None, "", " ,;! ", "A,b.C", "a-b-c " * 30_000, texts[0], texts[0], texts[1].upper()]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])], pool


def test_lexical_search_equals_a_full_scan(spark, rows, corpus, monkeypatch):
    docs, pool = corpus
    rng = random.Random(6)
    queries = [(k, " ".join(rng.choices(pool, k=8))) for k in range(12)] + [(1, "a B c"), (40, None), (41, "?!"), (42, "zzz"), (None, "a")]
    table = spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in queries], "item_id long, text string, query long, doc_id long")
    wanted = ranked(docs, queries)
    assert rows(lexical_search(table, asked)) == wanted
    monkeypatch.setattr(lexical, "QUERIES", 5)  # several blocks of queries
    assert rows(lexical_search(table, asked)) == wanted
    assert rows(lexical_search(table.limit(0), asked)) == [] == rows(lexical_search(table, asked.limit(0)))


def test_blocks_bound_and_skip_without_loss():
    rng = np.random.default_rng(2)
    full = np.where(rng.random((400, 50)) < 0.15, rng.integers(1, 1000, (400, 50)), 0)
    full[100:140] = full[100]  # copies tie
    r, t = np.nonzero(full)
    segment = lexical.Segment(rng.permutation(400).astype(np.int64), r, t, full[r, t], 50)
    for _ in range(40):
        terms = np.sort(rng.choice(50, 6, replace=False))
        weights = rng.integers(1, 30, 6)
        found = segment.search(terms, weights, [], 7)
        scores = full[:, terms] @ weights
        assert found == sorted(((int(s), -int(i)) for s, i in zip(scores, segment.ids, strict=True) if s > 0), reverse=True)[:7]
    for docs, starts, summary, first in segment.blocked(3), segment.blocked(20):
        assert sorted(docs) == np.flatnonzero(segment.table[:, 3 if docs is segment.blocked(3)[0] else 20]).tolist()
        for a, b, s, f in zip(starts, [*starts[1:], len(docs)], summary, first, strict=True):
            assert (s == segment.table[docs[a:b]].max(axis=0)).all() and f == segment.ids[docs[a:b]].min()


def test_pieces_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 4)
    for text in (b"", b"ab", b"abcdefghij", b"ab cd,ef  gh ijklmnopq r", b"    "):
        assert [w for p in lexical.pieces(text) for w in lexical.alnum_words(p)] == lexical.alnum_words(text)


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    """Least id reachable by id; nodes: (id, value)."""
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(nodes, 2):
        if i == j or linked(x, y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_fingerprint(monkeypatch):
    rng = random.Random(1)
    texts = ["", "One", "one TWO", "a b c", "a a a a a", "é ß ü x y", " ".join(rng.choices("abcdef", k=500))]
    assert [fingerprint(lowered(t).encode().split()) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert fingerprint(texts[-1].encode().split()) == plain_fingerprint(texts[-1])


def clustered(rng, centres, members, spread):
    out = set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(members):
            out.add(c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, spread)), replace=False)))
    return np.array(sorted(out), np.uint64)


def test_vantage_point_tree_finds_every_link_once_placed():
    rng = np.random.default_rng(7)
    points = np.unique(np.concatenate((clustered(rng, 20, 40, 5), clustered(rng, 1, 600, 3), rng.integers(0, 1 << 63, 1500, dtype=np.uint64))))
    x, y = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))
    wanted = set(zip(points[x].tolist(), points[y].tolist(), strict=True))
    pairs = lambda found: {(min(p), max(p)) for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True) if p[0] != p[1]}
    assert pairs(self_links(points)) == wanted
    for leaves in (1, 2, 16, 64):
        nodes, count = build(rng.choice(points, min(len(points), leaves * 32), replace=False), leaves)
        assert count <= leaves
        homes, guests = defaultdict(list), defaultdict(list)
        for leaf, home, group in route(nodes, points):
            (homes if home else guests)[leaf].append(group)
        assert sorted(p for g in homes.values() for part in g for p in part.tolist()) == points.tolist()
        found = set()
        for leaf, parts in homes.items():
            own = np.concatenate(parts)
            found |= pairs(self_links(own))
            if leaf in guests:
                crossing = pairs(cross_links(own, np.concatenate(guests[leaf])))
                assert not crossing & found
                found |= crossing
        assert found == wanted


def test_simhash_groups_equal_brute_force(spark, rows):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{k}" for k in range(90)], k=400)) for _ in range(6)]
    texts = [None, "", "  ", "x", "X", "x y", *base, *base, *(b + " end" for b in base), *(b.replace(" ", "\n", 3) for b in base)]
    for b in base:
        w = b.split()
        for k in range(12):
            w[30 * k] = "changed"
            texts.append(" ".join(w))
    docs = [(k + 5, t) for k, t in enumerate(texts)] + [(40, "quite another text here"), (None, base[0])]
    got = rows(simhash_groups(spark.createDataFrame([(i, t, 1, "a", "b", 2) for i, t in docs], DOCS).repartition(4)))
    nodes = [(i, plain_fingerprint(t)) for i, t in docs]
    root = grouped([n for n in nodes if n[0] is not None], lambda x, y: (x ^ y).bit_count() <= 3)
    assert got == sorted(((i, f"{f:016x}", root.get(i)) for i, f in nodes), key=repr)
    assert rows(simhash_groups(spark.createDataFrame([], DOCS))) == []


def test_links_over_many_leaves_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    points = np.unique(np.concatenate((clustered(rng, 30, 20, 6), rng.integers(0, 1 << 63, 800, dtype=np.uint64))))
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    root = grouped([(int(p), int(p)) for p in points], lambda x, y: (x ^ y).bit_count() <= 3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(table, leaf=64).collect()]
    assert len(edges) < 4 * len(points)
    assert grouped([(int(p), int(p)) for p in points], lambda x, y, e=set(edges) | {(b, a) for a, b in edges}: (x, y) in e) == root


# --- conversations ---------------------------------------------------------------------------------------------------


def audits(rows):
    """Cheapest cost, least audit and repaired lines over all edits; rows: (role, text)."""
    seen, faults = set(), []
    for role, text in rows:
        left = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(0, "", [])]
    for k, fault in enumerate([*faults, None]):
        fresh = []
        for cost, audit, lines in best:
            for ins in [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]:
                own = (cost + 2 * len(ins), audit + "I" * len(ins), [*lines, *((r, "") for r in ins)])
                if fault is None:
                    fresh.append(own)
                    continue
                role, text = rows[k]
                fresh.append((own[0] + 3, own[1] + "D", own[2]))
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    fresh.append((own[0] + late, own[1] + "K", [*own[2], (role, text)]))
                    fresh += [(own[0] + late + 2, own[1] + "R", [*own[2], (r, text)]) for r in ("user", "assistant")]
        best = [f for f in fresh if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in f[2]))]
    best = [b for b in best if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in b[2]))]
    cost, audit, lines = min(best, key=lambda b: b[:2])
    return faults, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def expected(conv_id, turns):
    rows = [(r, t) for _, r, t in turns]
    faults, cost, audit, digest = audits(rows)
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


ROLES = ["user", "assistant", "system", "tool", "", "user", "assistant"]
TEXTS = ["", " \n", "Yes.", "Yes", "No! ", "é", "Why?\x0b"]
CONV = "conv_id long, turn long, role string, text string, kind string, part int, copies string"


def conversation(rng, n):
    rows = [(rng.choice([None, 1, 2, 3, 5, 9]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repair_equals_all_edits(spark, rows):
    rng = random.Random(4)
    made = {k: conversation(rng, rng.randint(1, 4)) for k in range(60)}
    table = [(k, *r, "x", 1, "y") for k, turns in made.items() for r in turns]
    rng.shuffle(table)
    assert rows(repair(undamaged(spark.createDataFrame(table, CONV)))) == sorted((expected(k, t) for k, t in made.items()), key=repr)


def test_runs_of_a_long_conversation_join_to_the_same_audit(monkeypatch):
    rng = random.Random(12)
    for n, size in ((4, 1), (4, 2), (60, 7), (60, 1000)):
        turns = conversation(rng, n)
        first, stream = set(), [{"conv_id": 0, "part": 0, "dropped": False, "turn": None, "role": b"user", "text": b"Hi.", "copies": 1, "first": True}]
        for (turn, role, text), copies in Counter(turns).items():
            stream.append({"conv_id": 1, "part": 0, "dropped": False, "turn": turn, "role": role.encode(), "text": text.encode(), "copies": copies})
            stream[-1]["first"] = (role, text) not in first
            first.add((role, text))
        monkeypatch.setattr(conversations, "RUN_ROWS", size)
        runs = list(conversations._runs(iter(stream)))
        done = [r for r in conversations._joined(r for r in runs if not r["whole"]) if r["conv_id"] == 1]
        monkeypatch.setattr(conversations, "RUN_ROWS", 10**6)
        whole = [r for r in conversations._joined(conversations._runs(iter(stream))) if r["conv_id"] == 1]
        same = lambda r: {k: v for k, v in r.items() if k not in ("split", "repaired_sha256")}
        assert len(done) == len(whole) == 1 and same(done[0]) == same(whole[0])
        feed = [{"conv_id": 1, "dropped": True, "role": b"", "text": done[0]["audit"].encode(), "copies": 0}, *stream[1:]]
        assert list(conversations._digests(iter(feed))) == [{"conv_id": 1, "digest": whole[0]["repaired_sha256"]}]
        if n == 4:
            assert (whole[0]["cost"], whole[0]["audit"], whole[0]["repaired_sha256"]) == expected(1, turns)[-3:]


def test_conversation_larger_than_a_task_range(spark, rows):
    turns = [(k, ("user", "assistant")[k % 2] if k % 7 else "tool", f"Line {k}" + "." * (k % 3)) for k in range(4000)]
    table = spark.createDataFrame([(1, *t, "x", 1, "y") for t in turns] + [(2, 0, "user", "Hi.", "x", 1, "y")], CONV).repartition(6)
    got = rows(repair(undamaged(table)))
    stream = [{"conv_id": 1, "part": 0, "dropped": False, "turn": k, "role": r.encode(), "text": t.encode(), "copies": 1, "first": True} for k, r, t in turns]
    one = list(conversations._runs(iter(stream)))[0]
    assert got[0] == (1, 0, 0, 0, one["truncated"], one["illegal"], one["cost"], one["audit"], one["repaired_sha256"])
    assert got[1] == expected(2, [(0, "user", "Hi.")])


def test_damage_nulls_repeats_and_dropped_conversations(spark, rows):
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rng = random.Random(3)
    gone = next(c for c in range(1000, 9999) if kind(c, 0) == 0)
    data = [(c, t, rng.choice([*ROLES, None]), rng.choice([*TEXTS, None])) for c in [None, *range(80)] for t in (None, 0, 1, 2) if rng.random() < 0.8]
    data += data[:20] + [(gone, 0, "user", "Hi.")]
    made = defaultdict(list)
    for c, t, role, text in data:
        k, role, text = kind(c, t), " " if role is None else role, " " if text is None else text
        made[c] += {0: [], 1: [(t, role, "")], 2: [(t, role, re.sub("[.!?]", "", text))], 3: [(t, role, text)] * 2, 4: [(t, "user", text)]}.get(k, [(t, role, text)])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    wanted = [expected(c, sorted(t, key=order)) for c, t in made.items() if len(t) <= 5]
    got = rows(repair(damaged(spark.createDataFrame([(*r, "x", 1, "y") for r in data], CONV))))
    assert len(got) == len(made) and (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert set(wanted) <= set(got)
    assert rows(repair(damaged(spark.createDataFrame([], CONV)))) == []


def test_trails_of_equal_hash_are_compared_by_labels():
    root = Trail(None, b"")
    x, y = (Trail(Trail(Trail(root, b"K"), last), b"K") for last in (b"D", b"R"))
    for a, b in ((x, y), (x.up[0], y.up[0])):
        a.hash = b.hash = 5  # a collision
    assert conversations.before(x, y) and not conversations.before(y, x) and not conversations.same(x, y)
    same = Trail(Trail(Trail(root, b"K"), b"D"), b"K")
    same.hash, same.up[0].hash = x.hash, x.up[0].hash
    assert conversations.same(x, same) and not conversations.before(x, same)
