"""Tables, quality checks, files and stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kohorta.operators import quality, tables
from kohorta.session import scratch_path, settle
from kohorta.sources import csv
from kohorta.sources.codes import small_frame
from kohorta.sources.tables import load_for_codes, load_for_cohort, load_table, stack_sources


@pytest.fixture(scope="module")
def people(spark):
    data = [("x", "F", 1.0), ("x", "M", 2.0), ("x", None, 3.0), ("y", "F", 10.0), ("y", "F", None), (None, "M", 7.0)]
    return spark.createDataFrame(data, "g string, sex string, age double")


def test_frequency_and_crosstab(people, rows):
    assert rows(tables.frequency(people, "sex")) == sorted([("F", 3), ("M", 2), (None, 1)], key=repr)
    assert rows(tables.frequency(people, "sex", with_null=False)) == [("F", 3), ("M", 2)]
    assert rows(tables.crosstab(people, "g", "sex", ["F", "M"])) == sorted([("x", 1, 1, 3), ("y", 2, 0, 2), (None, 0, 1, 1)], key=repr)


def test_baseline_table(people):
    table = tables.baseline_table(people, "g", medians=["age"], means=["age"], factors=["sex"])
    got = {(r.variable, r.level, r.stratum): r for r in table.where("median is null and mean is null").collect()}
    assert (got["sex", "F", "x"].n, got["sex", "F", "x"].pct) == (1, 50.0)
    assert (got["sex", "F", "Total"].n, got["sex", "F", "Total"].pct) == (3, 60.0)
    assert got["sex", None, "x"].pct is None
    med = {r.stratum: (r.n, r.median) for r in table.where("median is not null").collect()}
    assert med == {"x": (3, 2.0), "y": (1, 10.0), "Total": (5, 3.0)}
    avg = {r.stratum: r["mean"] for r in table.where("mean is not null").collect()}
    assert avg == {"x": 2.0, "y": 10.0, "Total": pytest.approx(23 / 5)}
    text = tables.printed_baseline(table.where("mean is null"), ["x", "y"])
    got = {(r.variable, r.level): (r.x, r.y, r.Total) for r in text.collect()}
    assert got["age", None] == ("2.0 [1.5;2.5]", "10.0 [10.0;10.0]", "3.0 [2.0;7.0]")
    assert got["sex", "M"] == ("1 (50.0)", None, "2 (40.0)")


def test_chi_square_by_hand(spark):
    df = spark.createDataFrame([("a", "u")] * 10 + [("a", "v")] * 20 + [("b", "u")] * 30, "g string, f string")
    r = tables.chi_square(df, "g", ["f"]).first()
    # expected 20, 10, 20, 10
    assert r["statistic"] == pytest.approx(100 / 20 + 100 / 10 + 100 / 20 + 100 / 10)
    assert (r["dof"], r["n"]) == (1, 60)


def test_flow_counts_the_lost(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, None)], "patientid long, d string")
    b = a.where("patientid > 1")
    flow = tables.cohort_flow({"all": a, "late": b})
    assert rows(flow, "step", "n_rows", "n_patients", "n_excluded") == [("all", 4, 3, None), ("late", 2, 2, 1)]
    by = tables.cohort_flow({"all": a, "late": b}, by="d")
    assert rows(by.where("step_no = 1"), "d", "n_excluded") == sorted([("x", 1), (None, 0)], key=repr)


def test_date_histogram_covers_all_rows(spark):
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=i % 100),) for i in range(1000)] + [(None,)], "d date")
    got = tables.date_histogram(df, "d", bins=10).orderBy("bin").collect()
    assert [r["bin"] for r in got] == list(range(1, 11))
    assert sum(r["n"] for r in got) == 1000 and got[0]["first_day"] == start


def test_quality_report(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, v int")
    report = quality.report([
        quality.expect_unique(df, "k", "unique"),
        quality.expect_values(df, "v", [2, 3], "values"),
        quality.expect_same_ids(df, df.where("k = 1"), "k", "ids"),
        quality.expect_all_true(df, F.col("k") > 0, "true"),
        quality.expect_equal(df.agg(F.count("*")), df.agg(F.count("*") + 2), "equal"),
    ])
    assert {r["check"]: (r["ok"], r["n_bad"]) for r in report.collect()} == {
        "unique": (False, 1), "values": (False, 1), "ids": (False, 1), "true": (True, 0), "equal": (False, 2)}


def test_counts_of_violations(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "n int")
    got = quality.report([quality.expect_none(df, "n", "some"), quality.expect_none(df.where("n = 0"), "n", "none")])
    assert {tuple(r) for r in got.collect()} == {("some", False, 2), ("none", True, 0)}


def test_european_csv(spark, rows):
    df = spark.createDataFrame([(1, 2.5, "a;b", dt.date(2020, 1, 2)), (2, None, None, None)], "i int, x double, s string, d date")
    path = scratch_path(spark, "t")
    csv.write_csv2(df, path)
    raw = spark.read.text(path)
    assert raw.where(F.col("value").contains("2,5")).count() == 1
    assert rows(csv.read_csv2(spark, path, df.schema)) == rows(df)
    path = scratch_path(spark, "t")
    csv.write_csv(df, path)
    assert rows(csv.read_csv(spark, path, df.schema)) == rows(df)


def test_stages_overwrite_and_reload(spark, rows):
    stages = csv.Stages(spark, scratch_path(spark, "stages"))
    stages.save("one", spark.range(3))
    assert rows(stages.save("one", spark.range(5))) == [(i,) for i in range(5)]
    assert stages.load("one").count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_stages_join_without_exchange(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stages = csv.Stages(spark, scratch_path(spark, "buckets"))
        events = spark.range(5000).select((F.col("id") % 97).alias("patientid"), F.col("id").alias("v"))
        left = stages.save_bucketed("events", events, "patientid", 4)
        right = stages.save_bucketed("index", spark.range(97).withColumnRenamed("id", "patientid"), "patientid", 4)
        joined = left.join(right, "patientid").groupBy("patientid").count()
        assert "Exchange" not in plan_of(joined)
        assert rows(joined) == rows(events.groupBy("patientid").count())
        assert stages.load("events").count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_year_folders_are_pruned(spark):
    stages = csv.Stages(spark, scratch_path(spark, "years"))
    start = F.lit("2018-01-01").cast("date")
    events = spark.range(2000).select(F.col("id"), F.date_add(start, F.col("id").cast("int")).alias("date"))
    saved = stages.save_by_year("events", events, "date")
    late = saved.where(F.col("year") >= 2020)
    assert "PartitionFilters: [isnotnull(year" in plan_of(late)
    assert late.count() == events.where(F.year("date") >= 2020).count()


def test_settled_table_reads_from_the_shared_folder(spark):
    df = settle(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "HashAggregate" not in plan
    assert df.count() == 2


def test_code_lists_are_local_relations(spark):
    df = small_frame(spark, [("a", 1), ("b", None)], ["k", "v"])
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_restricted_loads_push_down(spark, rows):
    path = scratch_path(spark, "labs")
    spark.createDataFrame([(1, "A", 1.0), (2, "B", 2.0), (3, "A", 3.0)], "patientid long, npu string, value double").write.parquet(path)
    labs = load_table(spark, path, columns=["patientid", "npu"])
    coded = load_for_codes(labs, ["A", "A"], "npu")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<patientid:bigint,npu:string>" in plan and "PushedFilters: [IsNotNull(npu), EqualTo(npu,A)]" in plan
    ids = spark.createDataFrame([(3,)], "patientid long")
    assert rows(load_for_cohort(labs, ids)) == [(3, "A")]
    both = stack_sources({"one": coded, "two": labs})
    assert rows(both.groupBy("source").count()) == [("one", 2), ("two", 3)]
