"""Exact order statistics against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import distribution as dist


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in np.round(rng.normal(0, 50, 400), 1)]
    data += [("b", float(v)) for v in rng.lognormal(0, 4, 301)]
    data += [("c", 0.0)] * 7 + [("d", None)] + [(None, 2.0), (None, 4.0)]
    return data, spark.createDataFrame(data, "g string, x double")


def test_order_key_is_the_bit_form(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(0, 1e3, 3000), 10.0 ** rng.uniform(-307, 307, 500), -(2.0 ** np.arange(-1074, 1024, 7)), 2.0 ** np.arange(-1074, 1024, 7), [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, np.inf, -np.inf]])
    with np.errstate(over="ignore"):
        xs = np.unique(np.concatenate([xs, np.nextafter(xs, np.inf), np.nextafter(xs, -np.inf)]))
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    got = {r.x: r.b for r in df.select("x", dist.order_key(F.col("x")).alias("b")).collect()}
    bits = np.abs(xs).view(np.int64)
    assert [got[x] for x in xs.tolist()] == np.where(xs < 0, -bits, bits).tolist()
    edge = spark.createDataFrame([(-0.0,), (float("nan"),)], "x double").select(dist.order_key(F.col("x"))).collect()
    assert edge[0][0] == 0 and edge[1][0] > 0x7FF << 52


def test_narrow_band_of_values_is_split_by_further_bits(spark, monkeypatch):
    monkeypatch.setattr(dist, "LIMIT", 50)
    rng = np.random.default_rng(5)
    close = 1.7e9 + rng.integers(0, 100_000, 3000) + 0.25
    near = 1.0 + rng.integers(0, 400, 2000) * 2.0**-52  # neighbours in the last bits
    data = [("s", float(v)) for v in close] + [("n", float(v)) for v in near] + [("h", 7.0)] * 900 + [("h", 8.0)] * 3 + [(None, float(v)) for v in close[:500]]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: list(r)[1:] for r in dist.quantiles(df, ["g"], "x", probs, list("abcde")).collect()}
    for g in ("s", "n", "h", None):
        own = np.array([x for k, x in data if k == g])
        assert got[g] == pytest.approx(list(np.quantile(own, probs)), rel=1e-15)
    assert list(dist.quantiles(df.where("g = 's'"), [], "x", [0.5], ["m"]).first()) == [np.median(close)]
    assert dist.quantiles(df.where("false"), ["g"], "x", [0.5], ["m"]).collect() == []


def test_quantiles(values):
    data, df = values
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r)[1:] for r in dist.quantiles(df, ["g"], "x", probs, [f"p{i}" for i in range(6)]).collect()}
    for g in ("a", "b", "c", None):
        want = np.quantile([x for k, x in data if k == g and x is not None], probs)
        assert got[g] == pytest.approx(list(want), rel=1e-12, abs=1e-12)
    assert "d" not in got


def test_six_numbers_and_ungrouped(values):
    data, df = values
    xs = np.array([x for _, x in data if x is not None])
    r = dist.six_numbers(df, [], "x").first()
    assert (r["min"], r["max"], r["n"], r["n_missing"]) == (xs.min(), xs.max(), len(xs), 1)
    assert [r["q1"], r["median"], r["q3"]] == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.75])))
    d = {r["g"]: r for r in dist.six_numbers(df, ["g"], "x").collect()}
    assert d[None]["median"] == 3.0


def test_counts_below(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (-2.0,), (0.0,)], "x double")
    got = {r.x: (r.below, r.total) for r in dist.counts_below(dist.value_counts(df, [], "x"), []).collect()}
    assert got == {-2.0: (0, 5), 0.0: (1, 5), 1.0: (2, 5), 3.0: (3, 5)}


def test_kruskal_wallis_by_hand(spark):
    # ranks: 1, 2.5, 2.5, 4, 5.5, 5.5
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4), ("c", 4)], "g string, x int")
    r = dist.kruskal_wallis(df, "g", "x").first()
    sums = [3.5, 6.5, 11.0]
    h = 12 / (6 * 7) * sum(s * s / 2 for s in sums) - 3 * 7
    want = h / (1 - (2 * (8 - 2)) / (216 - 6))
    assert math.isclose(r["statistic"], want, rel_tol=1e-12)
    assert (r["dof"], r["n"]) == (2, 6)


def test_ranks_over_many_ranges_and_variables(spark):
    rng = np.random.default_rng(8)
    rows = [(rng.choice(["a", "b", "c"]), int(rng.integers(0, 40)), float(rng.normal()), None if k % 3 else 1.5) for k in range(600)]
    rows += [(None, 5, 1.0, 2.0), ("a", None, None, None)]
    df = spark.createDataFrame([(str(g) if g else None, *r) for g, *r in rows], "g string, x int, y double, z double").repartition(6)
    got = {r.variable: r for r in dist.kruskal_tests(df, "g", ["x", "y", "z"]).collect()}
    for k, name in enumerate("xyz"):
        data = [(r[0], r[k + 1]) for r in rows if r[0] is not None and r[k + 1] is not None]
        xs = np.array([v for _, v in data], float)
        rank = np.array([(xs < v).sum() + ((xs == v).sum() + 1) / 2 for v in xs])
        n, groups = len(xs), sorted({g for g, _ in data})
        h = sum(rank[[g == q for g, _ in data]].sum() ** 2 / sum(g == q for g, _ in data) for q in groups) * 12 / n / (n + 1) - 3 * (n + 1)
        ties = sum(int((xs == v).sum()) ** 3 - int((xs == v).sum()) for v in np.unique(xs))
        assert (got[name].dof, got[name].n) == (len(groups) - 1, n)
        if name != "z":
            assert got[name].statistic == pytest.approx(h / (1 - ties / (n**3 - n)), rel=1e-9)
    below = {r.x: (r.below, r.ties, r.total) for r in dist.counts_below(dist.value_counts(df, [], "x"), []).collect()}
    xs = [r[1] for r in rows if r[1] is not None]
    assert below == {v: (sum(w < v for w in xs), xs.count(v), len(xs)) for v in set(xs)}


def test_box_limits_drop_first(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100, 1000]], "x double")
    r = dist.box_stats(df, [], "x", low=0, high=100).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"], r["n"]) == (1.0, 4.0, 1, 5)
