"""Class bitmaps against sets, scans by code."""

from __future__ import annotations

import random

import pytest

from kohorta.operators import bitmaps as bm
from kohorta.sources.tables import load_for_codes, store_by_code


def _exposure(spark, rows):
    return spark.createDataFrame(rows, "patientid long, atc3 string")


def test_numbers_have_no_gaps(spark):
    ids = [(k * 1_000_003,) for k in range(5000)] + [(0,), (None,)]
    cohort = spark.createDataFrame(ids, "patientid long").repartition(7)
    got = [tuple(r) for r in bm.subject_numbers(cohort).collect()]
    assert sorted(n for _, n in got) == list(range(5000))
    assert {i for i, _ in got} == {k * 1_000_003 for k in range(5000)}


def test_bitmaps_count_like_sets(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40_000) * 17, rng.choice("ABCDE")) for _ in range(90_000)]
    rows += [(17, "A")] * 30_000 + [(17, None), (None, "A"), (5, "Z")]  # a hot subject, nulls, one outside the cohort
    cohort = spark.range(0, 40_000).selectExpr("id * 17 as patientid")
    bitmaps = bm.class_bitmaps(_exposure(spark, rows), bm.subject_numbers(cohort))
    sets = {}
    for i, c in rows:
        if i is not None and c is not None and i % 17 == 0:
            sets.setdefault(c, set()).add(i)
    assert {r.atc3: r.n for r in bm.subjects_per_class(bitmaps).collect()} == {c: len(s) for c, s in sets.items()}
    groups = {"ab": ["A", "B"], "none": ["Q"], "all": list("ABCDE")}
    want = {g: len(set().union(*(sets.get(c, set()) for c in names))) for g, names in groups.items()}
    assert {r.grp: r.n for r in bm.subjects_of_any(bitmaps, groups).collect()} == want


def test_bitmaps_of_nothing(spark):
    empty = _exposure(spark, [])
    bitmaps = bm.class_bitmaps(empty, bm.subject_numbers(empty))
    assert bm.subjects_per_class(bitmaps).collect() == [] and bm.class_domain(empty) == []


def test_domain_is_found_and_bounded(spark):
    rows = _exposure(spark, [(1, "B02"), (2, "A01"), (3, None), (4, "A01")])
    assert bm.class_domain(rows) == ["A01", "B02"]
    with pytest.raises(ValueError, match="more than 1"):
        bm.class_domain(rows, most=1)


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_code_filter_reaches_the_scan(spark, tmp_path):
    labs = spark.range(2000).selectExpr("id as patientid", "concat('NPU', id % 50) as npu", "cast(id as double) as value")
    stored = store_by_code(labs, str(tmp_path / "labs"), "npu")
    found = load_for_codes(stored, ["NPU7", "NPU9", "NPU7"], "npu")
    assert found.count() == 80
    assert "In(npu, [NPU7,NPU9])" in _plan(found)
    assert sorted(stored.collect()) == sorted(labs.collect())


def test_pieces_of_a_code_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(600).selectExpr("id", "substring('ARN', id % 3 + 1, 1) as flag", "substring('FO', id % 2 + 1, 1) as status").write.parquet(path)
    coded = spark.read.parquet(path).selectExpr("id", "flag", "status", "concat(flag, status) as npu")
    found = load_for_codes(coded, ["AF", "NO"], "npu", pieces=[("flag", 0, 1), ("status", 1, 1)])
    assert {r.npu for r in found.collect()} == {"AF", "NO"}
    assert found.count() == coded.where("npu in ('AF', 'NO')").count()
    plan = _plan(found)
    assert "In(flag, [A,N])" in plan and "In(status, [F,O])" in plan
