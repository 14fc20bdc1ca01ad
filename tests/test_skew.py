"""One subject owns a third of all events: same results, and the work is split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kohorta.operators import events as ev
from kohorta.operators import exposure as ex
from kohorta.operators.keyed import with_totals
from kohorta.operators.nearest import nearest_values

N = 60_000
START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Events of 2,000 subjects; subject 0 has a third of them."""
    who = F.when(F.rand(1) < 1 / 3, F.lit(0)).otherwise((F.rand(2) * 2000).cast("int")).cast("long")
    df = spark.range(N).select(
        who.alias("patientid"),
        F.date_add(F.lit(START), (F.rand(3) * 700).cast("int")).alias("date"),
        F.concat(F.lit("A"), (F.rand(4) * 300).cast("int").cast("string")).alias("atc"),
        F.round(F.rand(5) * 100, 1).alias("value"),
    )
    rows = [tuple(r) for r in df.collect()]
    events = spark.createDataFrame(rows, df.schema)
    index = spark.createDataFrame([(k, START + dt.timedelta(days=500)) for k in range(2000)], "patientid long, date_diagnosis date")
    return rows, events, index


@pytest.fixture
def small_limits(spark):
    """Limits at which the hot partition counts as skewed at this size."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookback_join_splits_the_hot_subject(hot, small_limits):
    rows, events, index = hot
    counted = ex.polypharmacy(index, events)
    assert "skew=true" in final_plan(ex.lookback(index, events))
    idx = START + dt.timedelta(days=500)
    want: dict = {}
    for who, day, atc, _ in rows:
        if dt.timedelta(0) <= idx - day <= dt.timedelta(days=365):
            want.setdefault(who, set()).add(atc)
    assert {r.patientid: r.n_atc for r in counted.collect()} == {k: len(want.get(k, ())) for k in range(2000)}


def test_nearest_value_with_a_hot_subject(hot, small_limits):
    rows, events, index = hot
    labs = events.select("patientid", "date", F.lit("A").alias("npu"), "value")
    got = {r.patientid: r.a_value for r in nearest_values(index, labs, {"a": ["A"]}).collect()}
    best: dict = {}
    for who, day, _, value in rows:
        gap = (day - START).days - 500
        if abs(gap) <= 30:
            best[who] = min(best.get(who, (99, 0, 0.0)), (abs(gap), gap, value))
    assert got == {k: best[k][2] if k in best else None for k in range(2000)}


def test_totals_need_no_window(hot, small_limits):
    rows, events, _ = hot
    out = with_totals(events, ["patientid"], n=F.count(F.lit(1)))
    assert "Window" not in final_plan(out)
    assert out.where("patientid = 0").first().n == sum(r[0] == 0 for r in rows)


def test_stays_window_is_bounded_by_the_chunk(spark):
    """No window of the pairing runs over the subject alone, but for the chunk summary."""
    rnd = random.Random(3)
    events = [
        (0 if rnd.random() < 0.34 else rnd.randrange(1, 50),
         dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(60 * 24 * 30)),
         rnd.choice(["IND", "UD"]))
        for _ in range(6000)
    ]
    raw = spark.createDataFrame(events, "patientid long, effective_time timestamp_ntz, event_type_name string")
    found = ev.stays(ev.adt_events(raw, {"IND": "IND", "UD": "UD"}))
    specs = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    by_subject = [s for s in specs if "_chunk" not in s.split("], [")[1]]
    assert specs and all("_e_" in s for s in by_subject)
    want = 0
    for k in {e[0] for e in events}:
        open_, last = False, None
        for t, kind in sorted({(t, kind) for kk, t, kind in events if kk == k}, key=lambda e: (e[0], e[1] != "IND")):
            if kind == "IND":
                open_ = True
            elif open_:
                open_, want = False, want + 1
    assert found.count() == want


def test_episode_window_sees_days_not_rows(hot):
    rows, events, _ = hot
    found = ev.infection_episodes(events, max_gap_days=1)
    assert found.where("patientid = 0").agg(F.sum("n_days_iv")).first()[0] == len({r[1] for r in rows if r[0] == 0})
