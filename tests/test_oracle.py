"""Every registered query against its SQL twin, on the smallest data folder."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry_module  # noqa: E402
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_matches_sql(spark, duck, name):
    assert compare.compare(spark, duck, SF, name) == ""


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["atc_bin", "t"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
