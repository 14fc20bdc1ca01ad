"""Chunked order-dependent columns against plain per-subject loops."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kohorta.operators import events as ev
from kohorta.operators.keyed import first_per_key
from kohorta.operators.ordered import Carry, carry, fill

START = dt.datetime(2024, 1, 1)


def make(seed, n=300, subjects=4, hot=0.5):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        who = 0 if rnd.random() < hot else rnd.randrange(1, subjects)
        out.add((who, START + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 12)), rnd.choice([None, 1, 2, 3])))
    seen, rows = set(), []
    for who, t, v in sorted(out, key=repr):
        if (who, t) not in seen:
            seen.add((who, t))
            rows.append((who, t, v))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_carry_matches_a_loop(spark, seed):
    data = make(seed)
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, v int")
    got = carry(
        df, ["k"], ["t"], F.date_trunc("day", F.col("t")),
        {
            "prev": Carry("lag", F.col("v")),
            "down": Carry("down", F.col("v")),
            "up": Carry("up", F.col("v")),
            "no": Carry("number"),
            "total": Carry("running", F.col("v")),
        },
    )
    got = {(r.k, r.t): (r.prev, r.down, r.up, r.no, r.total) for r in got.collect()}
    for k in {d[0] for d in data}:
        mine = sorted([(t, v) for kk, t, v in data if kk == k], key=lambda r: r[0])
        for i, (t, _) in enumerate(mine):
            before = [v for _, v in mine[: i + 1] if v is not None]
            after = [v for _, v in mine[i:] if v is not None]
            want = (
                mine[i - 1][1] if i else None,
                before[-1] if before else None,
                after[0] if after else None,
                i + 1,
                sum(before),
            )
            assert got[(k, t)] == want


def test_fill_both_ways(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 30, None), (1, 45, 7)], "k int, t int, v int")
    chunk = (F.col("t") / 10).cast("int")
    assert [r.v for r in fill(df, ["k"], ["t"], chunk, "v").orderBy("t").collect()] == [None, 5, 5, 7]
    assert [r.v for r in fill(df, ["k"], ["t"], chunk, "v", up=True).orderBy("t").collect()] == [5, 5, 7, 7]


def brute_stays(events):
    """Stays by walking through one subject's events."""
    out, open_at = [], None
    for t, kind in sorted(events, key=lambda e: (e[0], 0 if e[1] == "IND" else 1)):
        if kind == "IND" and open_at is None:
            open_at = t
        elif kind == "UD" and open_at is not None:
            out.append((open_at, t))
            open_at = None
    return out


def adt_frame(spark, events):
    raw = spark.createDataFrame(events, "patientid long, effective_time timestamp_ntz, event_type_name string")
    return ev.adt_events(raw, {"IND": "IND", "UD": "UD"})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 200), st.sampled_from(["IND", "UD", "other"])), min_size=1, max_size=60))
def test_stays_match_a_walk(spark, draws):
    events = [(k, START + dt.timedelta(hours=h), kind) for k, h, kind in draws]
    got = {}
    for r in ev.stays(adt_frame(spark, events)).collect():
        got.setdefault(r.patientid, []).append((r.date_admission, r.date_discharge))
    for k in {e[0] for e in events}:
        mine = {(t, kind) for kk, t, kind in events if kk == k and kind != "other"}
        assert sorted(got.get(k, [])) == brute_stays(mine)


def test_stay_edge_cases(spark):
    t = lambda h: START + dt.timedelta(hours=h)
    events = [
        (1, t(0), "UD"), (1, t(1), "IND"), (1, t(2), "IND"), (1, t(25), "UD"), (1, t(26), "UD"),
        (1, t(30), "IND"),  # never discharged
        (2, t(29), "IND"), (2, t(53), "UD"), (2, t(53), "UD"),  # exactly a day, exact copy row
        (3, t(5), "IND"), (3, t(5), "UD"),  # same time
    ]
    found = ev.stays(adt_frame(spark, events))
    assert sorted((r.patientid, r.days) for r in found.collect()) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert ev.long_stays(found).count() == 0
    long = ev.long_stays(found, more_than_days=0.5)
    assert {r.patientid: (r.n_contacts, r.days_in_hospital) for r in long.collect()} == {1: (1, 1.0), 2: (1, 1.0)}


def test_chunk_width_does_not_matter(spark, rows):
    rnd = random.Random(5)
    events = [(rnd.choice([1, 1, 2]), START + dt.timedelta(minutes=rnd.randrange(40000)), rnd.choice(["IND", "UD"])) for _ in range(400)]
    frame = adt_frame(spark, events)
    results = [rows(ev.stays(frame, chunk=c)) for c in ("hour", "day", "month", "year")]
    assert all(r == results[0] for r in results)


def test_first_per_key_total_order(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, 5, "b"), (1, 5, "a"), (2, None, "q")], "k int, t int, c string")
    got = {r.k: (r.t, r.c) for r in first_per_key(df, ["k"], ["t", "c"]).collect()}
    assert got == {1: (5, "a"), 2: (None, "q")}
    last = {r.k: (r.t, r.c) for r in first_per_key(df, ["k"], ["t", "c"], latest=True).collect()}
    assert last[1] == (5, "b")
