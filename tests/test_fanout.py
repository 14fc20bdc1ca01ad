"""One pass over the events against the operators that look once each."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kohorta.functions.dates import lookback_bounds
from kohorta.operators import exposure as ex
from kohorta.operators import scores
from kohorta.operators.fanout import INDEX_DATE, distinct_look, fan_out, mask_look, nearest_look
from kohorta.operators.nearest import nearest_values
from kohorta.operators.prefixes import prefix_mask

T0 = dt.date(2020, 6, 1)
WEIGHTS = [("mild", "DK7", 1, 2), ("mild", "DK70", 1, 2), ("severe", "DK71", 3, 4), ("own", "DC", 2, 2), ("all", "D", 5, 0)]
LABELS = ["mild", "severe", "own", "all"]
SF = "/root/testdata/sf0.001"


def events(spark, n=3000, subjects=40):
    """Rows with nulls in any column; subject 0 holds a third of them and the last subject none."""
    draw = random.Random(5)
    rows = []
    for _ in range(n):
        who = 0 if draw.random() < 1 / 3 else draw.randrange(subjects - 1)
        date = T0 + dt.timedelta(days=draw.randrange(-800, 200))
        lab = T0 + dt.timedelta(days=draw.randrange(-60, 60))
        rows.append(
            [who, date, draw.choice("ABCDEFG"), draw.choice(["DK7", "DK709", "DK712", "DC1", "E1", "D"]), lab,
             draw.choice(["x", "y"]), float(draw.randrange(5))]
        )
        if draw.random() < 0.2:
            rows[-1][draw.randrange(7)] = None
    return spark.createDataFrame(rows, "patientid long, date date, atc string, icd10 string, lab_date date, npu string, value double")


def test_one_pass_equals_one_look_each(spark):
    log = events(spark)
    index = spark.createDataFrame([(k, T0 + dt.timedelta(days=k)) for k in range(40)], "patientid long, date_diagnosis date")
    low, high = lookback_bounds(F.col(INDEX_DATE))
    day, lab_day = F.col("date"), F.col("lab_date")
    near = lab_day.between(F.date_add(INDEX_DATE, -30), F.date_add(INDEX_DATE, 30))
    looks = {
        "n_atc": distinct_look((day >= low) & (day <= high), F.col("atc")),
        "groups": mask_look(day <= F.col(INDEX_DATE), prefix_mask(F.col("icd10"), [(p, g) for g, p, *_ in WEIGHTS], LABELS)),
        "x_value": nearest_look(near & (F.col("npu") == "x"), F.col("value"), lab_day),
    }
    hierarchy, always = {"severe": "mild"}, [("own", 2, 2)]
    one = index.join(fan_out(index, log, looks), "patientid", "left")
    both = scores.mask_score(F.col("groups"), WEIGHTS, LABELS, hierarchy, always)
    got = {
        r[0]: tuple(r[1:])
        for r in one.select("patientid", F.coalesce("n_atc", F.lit(0)), "x_value", *both).collect()
    }

    drugs = ex.polypharmacy(index, log.select("patientid", "date", "atc"))
    labs = log.select("patientid", F.col("lab_date").alias("date"), "npu", "value")
    values = nearest_values(index, labs, {"x": ["x"]})
    found = scores.code_groups(ex.history(index, log), WEIGHTS)
    summed = scores.weighted_score(index.select("patientid"), found, LABELS, hierarchy, always)
    each = drugs.join(values.select("patientid", "x_value"), "patientid").join(summed, "patientid")
    want = {
        r[0]: tuple(r[1:]) for r in each.select("patientid", "n_atc", "x_value", "cci_score", "cci_update").collect()
    }
    assert got == want and len(got) == 40
    assert got[39] == (0, None, 2, 2)


def test_no_events_and_no_subjects(spark):
    log = events(spark, 50)
    index = spark.createDataFrame([(1, T0)], "patientid long, date_diagnosis date")
    looks = {"n": distinct_look(F.col("date") <= F.col(INDEX_DATE), F.col("atc"))}
    assert fan_out(index, log.limit(0), looks).collect() == []
    assert fan_out(index.limit(0), log, looks).collect() == []


def test_attached_rows_are_counted_where_listed(spark):
    index = spark.createDataFrame([(1, T0), (2, T0)], "patientid long, date_diagnosis date")
    log = spark.createDataFrame([(1, T0, 7), (1, T0, 8), (2, T0, 8)], "patientid long, date date, part int")
    parts = spark.createDataFrame([(7, None)], "part int, atc string").withColumn("listed", F.lit(True))
    looks = {"n": distinct_look(F.col("date") <= F.col(INDEX_DATE), F.col("atc"), F.col("listed"))}
    out = fan_out(index, log, looks, lambda rows: rows.join(parts, "part", "left"))
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 0)}


def test_prefix_mask_equals_startswith(spark):
    draw = random.Random(3)
    codes = ["".join(draw.choice("AB1") for _ in range(draw.randrange(6))) for _ in range(300)] + [None]
    entries = [("A", "one"), ("AB", "two"), ("AB1", "one"), ("1", "three"), ("AB", "three"), ("B1A1", "two")]
    names = ["one", "two", "three"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    for code, mask in df.select("code", prefix_mask(F.col("code"), entries, names)).collect():
        hits = {g for p, g in entries if code is not None and code.startswith(p)}
        assert mask == (sum(1 << names.index(g) for g in hits) or None), code


def test_limits_are_errors(spark):
    with pytest.raises(ValueError):
        prefix_mask(F.col("c"), [("A", "g0")], [f"g{i}" for i in range(64)])
    with pytest.raises(ValueError):
        scores.mask_score(F.col("m"), [("a", "A", 1, 1), ("a", "B", 2, 1)], ["a"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_analysis_reads_the_lines_once(spark):
    from kohorta.plans.views import Clinic

    plan = Clinic(spark, SF).analysis._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan.*lineitem", plan)) == 1
    assert len(re.findall(r"FileScan.*orders", plan)) == 1


@pytest.mark.parametrize("latest_listed", [True, False])
def test_checked_look_equals_the_single_views(spark, tmp_path, latest_listed):
    from kohorta.plans.views import ICD_GROUPS, ICD_WEIGHTS, SCHEMAS, Clinic

    draw, day = random.Random(5), lambda n: dt.datetime(1995, 1, 1) + dt.timedelta(days=n)
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", None]
    orders = [(k, draw.choice([*range(40), None]), "F", 1.0, draw.choice([day(draw.randrange(900)), None]), draw.choice(kinds)) for k in range(600)]
    orders += [(600, 3, "F", 1.0, day(2000), "5-LOW"), (600, 4, "F", 1.0, day(2001), "5-LOW"), (None, 4, "F", 1.0, day(9), "2-HIGH")]
    part = lambda k: draw.choice([*range(300), 900 + k, None])
    lines = [(draw.choice([*range(600), None]), part(k), draw.randrange(30), k % 7, *[1.0] * 4, "N", "O", day(k)) for k in range(3000)]
    lines += [(600, 1 if latest_listed else 999_999, 2, 1, *[1.0] * 4, "N", "O", day(5))]
    parts = [(k % 290, "n", f"Brand#{k % 9}", draw.choice(["STEEL", "TIN", None]), k % 5, 1.0) for k in range(310)]
    for name, data in (("orders", orders), ("lineitem", lines), ("part", parts)):
        spark.createDataFrame(data, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    c = Clinic(spark, str(tmp_path))
    frame = c.checked(c.index)
    seen = {r.patientid: r for r in frame.collect()}
    n_rx = {r.patientid: r["count"] for r in ex.lookback(c.index, c.rx).groupBy("patientid").count().collect()}
    assert {k: r.n_rx for k, r in seen.items() if r.n_rx} == n_rx and not any(r.n_outside for r in seen.values())
    assert {k: r.n_atc for k, r in seen.items() if r.n_atc} == {r.patientid: r.n_atc for r in c.poly.collect() if r.n_atc}
    own = c.scored_groups(c.index, scores.mask_groups(frame, "groups", ICD_WEIGHTS, ICD_GROUPS))
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, c.comorbidity.collect()), key=repr)
    last = lambda df: df.agg(F.max("date")).first()[0]
    assert last(c.latest_rx()) == last(c.rx) == (day(2001).date() if latest_listed else last(c.rx.where("date < '2000-01-01'")))
