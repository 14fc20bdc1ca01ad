"""Null rules, dates, text, bins and p-value tails."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kohorta.functions import bins, dates, nulls, tails, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def null_bool():
    return F.lit(None).cast("boolean")


def test_unknown_condition_gives_unknown(spark):
    assert one(spark, nulls.if_na(null_bool(), 1, 2)) is None
    assert one(spark, nulls.if_na(F.lit(True), 1, 2)) == 1
    assert one(spark, nulls.if_na(F.lit(False), 1, 2)) == 2


def test_ladder_last_rung_wins_and_unknown_wipes(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, nulls.ladder([(t, "a"), (t, "b"), (f, "c")])) == "b"
    assert one(spark, nulls.ladder([(t, "a"), (null_bool(), "b")])) is None
    assert one(spark, nulls.ladder([(null_bool(), "a"), (t, "b")])) == "b"


def test_membership_keeps_nulls_when_negated(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(nulls.not_in(F.col("x"), ["a"])).collect()} == {"b", None}
    assert {r.x for r in df.where(nulls.is_in(F.col("x"), ["a"])).collect()} == {"a"}
    # the plain condition drops the null row
    assert df.where(~F.col("x").isin("a")).count() == 1


def test_nulls_last_in_both_directions(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in df.orderBy(F.col("x").asc_nulls_last()).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(F.col("x").desc_nulls_last()).collect()] == [2, 1, None]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 3)], "k int, x int")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(
        nulls.sum_strict(F.col("x")).alias("s"), nulls.max_strict(F.col("x")).alias("m")).collect()}
    assert got == {1: (None, None), 2: (3, 3)}


def test_later_of_is_unknown_with_a_null(spark):
    a, b = F.lit("2020-01-01").cast("date"), F.lit("2021-01-01").cast("date")
    none = F.lit(None).cast("date")
    assert one(spark, nulls.later_of(a, b)) == dt.date(2021, 1, 1)
    assert one(spark, nulls.later_of(b, a)) == dt.date(2021, 1, 1)
    assert one(spark, nulls.later_of(a, none)) is None


def test_void_before(spark):
    a, b = F.lit("2020-01-01").cast("date"), F.lit("2021-01-01").cast("date")
    assert one(spark, nulls.void_before(a, b)) is None
    assert one(spark, nulls.void_before(b, b)) == dt.date(2021, 1, 1)


@pytest.mark.parametrize("days,inside", [(1, False), (0, True), (-30, True), (-365, True), (-366, False)])
def test_lookback_window(spark, days, inside):
    assert one(spark, dates.in_lookback(F.lit(days))) is inside
    lo, hi = dates.lookback_bounds(F.lit("2020-06-30").cast("date"))
    day = F.date_add(F.lit("2020-06-30").cast("date"), days)
    assert one(spark, (day >= lo) & (day <= hi)) is inside


@pytest.mark.parametrize("days,inside", [(-29, False), (-30, True), (-31, True)])
def test_lookback_gap(spark, days, inside):
    assert one(spark, dates.in_lookback(F.lit(days), gap_days=30)) is inside


@pytest.mark.parametrize("window", [30, 30.5, 365.25])
def test_lookback_bounds_agree_with_the_predicate(spark, window):
    index = F.lit("2020-06-30").cast("date")
    lo, hi = dates.lookback_bounds(index, window, 3)
    df = spark.range(-400, 5).select(F.col("id").cast("int").alias("d"))
    day = F.date_add(index, F.col("d"))
    both = df.where(dates.in_lookback(F.col("d"), window, 3) != ((day >= lo) & (day <= hi)))
    assert both.count() == 0


def test_exact_days(spark):
    a = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    b = F.lit("2020-01-02 12:00:00").cast("timestamp_ntz")
    assert one(spark, dates.diff_days_exact(a, b)) == 1.5
    assert one(spark, dates.diff_days_exact(b, a)) == -1.5


def test_exact_days_ignore_the_time_zone(spark):
    a = F.lit("2020-03-28 12:00:00.25").cast("timestamp_ntz")
    b = F.lit("2020-03-29 12:00:00.75").cast("timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Copenhagen")
    try:
        assert one(spark, dates.diff_days_exact(a, b)) == pytest.approx(1 + 0.5 / 86400, abs=1e-15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (3, 4, 7, 8, 11, 12)] + [(None,)], "x int")
    got = [r.b for r in df.select("x", bins.cut(F.col("x"), *bins.DRUG_COUNT_CUTS).alias("b")).collect()]
    assert got == ["0-3", "4-7", "4-7", "8-11", "8-11", ">11", None]


def test_code_cleaning(spark):
    df = spark.createDataFrame([(":A10BA02",), ("A10_BA02",), ("XXXA10ÅÅBA02",), ("ÅA10BA02",), (None,)], "x string")
    assert [r.c for r in df.select(text.clean_code(F.col("x")).alias("c")).collect()] == ["A10BA02"] * 4 + [None]


@pytest.mark.parametrize("raw,value", [("<4,0", 4.0), ("ca. 12 mg", 12.0), ("3.5", 3.5), ("-1,5", -1.5), ("none", None), ("", None)])
def test_lab_number(spark, raw, value):
    assert one(spark, text.lab_number(F.lit(raw))) == value


def test_p_text(spark):
    got = [one(spark, text.p_text(F.lit(v).cast("double"))) for v in (0.0001, 0.0126, 1.0, None)]
    assert got == ["<0.001", "0.013", "1.000", None]


def test_interval_text(spark):
    lo, hi = text.interval_parts(F.lit("[1.05;2.5]"))
    assert (one(spark, lo), one(spark, hi)) == (1.05, 2.5)


def test_tails_against_known_values():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(0.0, 4) == 1.0
    assert math.isclose(tails.chi_square_upper(40.0, 4), math.exp(-20) * 21, rel_tol=1e-12)
