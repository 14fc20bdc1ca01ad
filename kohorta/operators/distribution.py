"""Exact order statistics and ranks without gathering a group.

Quantiles come from radix selection.  A double has a 64-bit form that sorts like it (``order_key``).  A histogram over its
leading ``STEP`` bits, one map-side combined aggregate, tells which bucket holds a wanted rank; while such a bucket holds more
than ``LIMIT`` rows, the next bits of the rows in hit buckets only are counted.  At the end hit buckets are ordered.
No window sees more than 2**STEP buckets or ``LIMIT`` rows, however close together the values lie: after all 64 bits a
bucket is a single value.

Ranks come from range partitions: values are dealt by range, each range is summed, the sums are summed up in order, and within
a range a running sum gives the rows below each value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.session import settle

STEP = 16  # bits of a histogram
LIMIT = 1 << 17  # rows of a bucket that are ordered


def order_key(x: Column) -> Column:
    """The 64-bit form of a double as a long that rises with it: sign, exponent and mantissa; equal for 0 and -0, and the
    largest for NaN."""
    size = F.abs(x)
    rough = F.floor(F.log2(size))
    at = rough + F.when(size / F.pow(F.lit(2.0), rough) >= 2, 1).when(size / F.pow(F.lit(2.0), rough) < 1, -1).otherwise(0)
    normal = (at + 1023) * (1 << 52) + ((size / F.pow(F.lit(2.0), at) - 1) * float(1 << 52)).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    number = F.when(size < 2.2250738585072014e-308, tiny).when(size == float("inf"), F.lit(0x7FF << 52)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((0x7FF << 52) + 1)).when(x == 0, F.lit(0)).when(x < 0, -number).otherwise(number).cast("long")


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``keys, x, n``: rows per distinct non-null value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``keys, x, n`` of every non-null value, not counted."""
    return df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x"), F.lit(1).cast("long").alias("n"))


def _part(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def _with(rows: DataFrame, small: DataFrame, keys: Sequence[str], more: Column) -> DataFrame:
    """``rows`` (l) joined with ``small`` (r) on null-safe keys and one more condition; all of the left, the rest of the right."""
    cond = more
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    extra = [c for c in small.columns if c not in keys]
    return rows.alias("l").join(small.alias("r"), cond).select("l.*", *[f"r.{c}" for c in extra])


def counts_below(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``below`` (rows with a smaller value), ``ties`` (rows with this value) and ``total`` to value counts (keys, x, n);
    a value may stand in several rows."""
    keys = list(keys)
    ranged = counts.repartitionByRange(*keys, "x").withColumn("_r", F.spark_partition_id())
    ranged = settle(ranged, "ranges")
    sums = ranged.groupBy(*keys, "_r").agg(F.sum("n").alias("_m"))
    whole = Window.partitionBy(*_part(keys))
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys, "_r", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("total")
    ).withColumnRenamed("_r", "_s")
    placed = _with(ranged, sums, keys, F.col("l._r") == F.col("r._s"))
    upto = Window.partitionBy(*keys, "_r").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_upto", F.sum("n").over(upto)).withColumn("ties", F.sum("n").over(Window.partitionBy(*keys, "_r", "x")))
    return placed.select(*counts.columns, (F.col("_before") + F.col("_upto") - F.col("ties")).alias("below"), "ties", "total")


def _wanted(probs: Sequence[float]) -> list[tuple[Column, str]]:
    """The two ranks between which each quantile lies."""
    out = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * F.lit(float(p))
        out += [(F.floor(position), f"_lo{i}"), (F.ceil(position), f"_hi{i}")]
    return out


def _hits(bars: DataFrame, within: list[str], base: Column, probs: Sequence[float]) -> DataFrame:
    """Of histogram rows (.., p, size) those whose ranks are wanted, with the rows ``before`` them."""
    run = Window.partitionBy(*_part(within)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    placed = bars.withColumn("before", base + F.coalesce(F.sum("size").over(run), F.lit(0)))
    if "total" not in bars.columns:
        placed = placed.withColumn("total", F.sum("size").over(Window.partitionBy(*_part(within))))
    hit = F.lit(False)
    for rank, _ in _wanted(probs):
        hit = hit | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("size")))
    return placed.where(hit)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str], total: str | None = None
) -> DataFrame:
    """Interpolated quantiles (position ``(n - 1) p``) per group of values (keys, x, n; a value may stand in several rows),
    one column per name; the number of values as ``total`` where asked for."""
    keys = list(keys)
    rows = settle(counts.select(*keys, order_key(F.col("x")).alias("_k"), "x", "n"), "values")
    digit = lambda shift: F.shiftright("_k", shift)
    shift = 64 - STEP
    bars = rows.groupBy(*keys, digit(shift).alias("p")).agg(F.sum("n").alias("size"))
    hits = settle(_hits(bars, keys, F.lit(0), probs), "hits")
    while shift > 0 and (hits.agg(F.max("size")).first()[0] or 0) > LIMIT:
        inside = _with(rows, hits.withColumnRenamed("p", "_p"), keys, F.shiftright("l._k", shift) == F.col("r._p"))
        shift -= STEP
        bars = inside.groupBy(*keys, "_p", "total", F.col("before").alias("_base"), digit(shift).alias("p")).agg(F.sum("n").alias("size"))
        hits = settle(_hits(bars, [*keys, "_p"], F.col("_base"), probs).select(*keys, "p", "size", "before", "total"), "hits")
    inside = _with(rows, hits, keys, F.shiftright("l._k", shift) == F.col("r.p"))
    values = inside.groupBy(*keys, "p", "before", "total", "x").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_below", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    picks = [
        F.max(F.when((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("n")), F.col("x"))).alias(label)
        for rank, label in _wanted(probs)
    ]
    found = values.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        position = (F.col("total") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(name))
    size = [F.col("total").alias(total)] if total else []
    return found.select(*keys, *out, *size)


def quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    return quantiles_of_counts(_values(df, keys, column), keys, probs, names)


def median_iqr(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median and quartiles per group, with the number of non-null values."""
    return quantiles_of_counts(_values(df, keys, column), keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], total="n")


def six_numbers(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum, count and missing count per group."""
    q = quantiles_of_counts(_values(df, keys, column), keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    x = F.col(column).cast("double")
    plain = df.groupBy(*keys).agg(
        F.min(x).alias("min"),
        F.avg(x).alias("mean"),
        F.max(x).alias("max"),
        F.count(x).alias("n"),
        F.count(F.when(x.isNull(), 1)).alias("n_missing"),
    )
    return _attach(plain, q, keys)


def box_stats(
    df: DataFrame, keys: Sequence[str], column: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Box-plot numbers per group, values outside the axis limits dropped first.

    Whiskers end at the last value within 1.5 times the interquartile range.
    """
    keys = list(keys)
    x = F.col(column)
    kept = df if low is None else df.where(x >= low)
    kept = kept if high is None else kept.where(x <= high)
    counts = settle(_values(kept, keys, column), "values")
    q = quantiles_of_counts(counts, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    fence = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("x") >= F.col("q1") - fence) & (F.col("x") <= F.col("q3") + fence)
    return (
        _attach(counts, q, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
            F.sum("n").alias("n"),
        )
    )


def kruskal_tests(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Tie-corrected Kruskal-Wallis statistic of each column (``variable, statistic, dof, n``), all in one plan; null
    where all values are equal."""
    x = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), *x).unpivot(["_g"], list(columns), "variable", "x")
    counts = long.where(F.col("x").isNotNull()).groupBy("variable", "_g", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts_below(counts, ["variable"])
    ties = F.col("ties").cast("double")
    # centred on the mean rank: smaller terms, and no difference of large sums
    rank = F.col("below") + (F.col("ties") + 1) / 2.0 - (F.col("total") + 1) / 2.0
    per_group = ranked.groupBy("variable", "_g").agg(
        F.sum(F.col("n") * rank).alias("r"), F.sum("n").alias("m"), F.max("total").cast("double").alias("total"),
        F.sum(F.col("n") * (ties * ties - 1)).alias("t"),
    )
    total = F.col("total")
    correction = 1 - F.col("t") / F.nullif(total * total * total - total, F.lit(0.0))
    return per_group.groupBy("variable").agg(
        F.sum(F.col("r") * F.col("r") / F.col("m")).alias("between"), (F.count(F.lit(1)) - 1).alias("dof"), F.sum("m").alias("n"),
        F.max("total").alias("total"), F.sum("t").alias("t"),
    ).select("variable", (12 * F.col("between") / (total * (total + 1)) / F.nullif(correction, F.lit(0.0))).alias("statistic"), "dof", "n")


def kruskal_wallis(df: DataFrame, group: str, column: str) -> DataFrame:
    """The statistic of one column (one row: ``statistic, dof, n``; none without a value)."""
    return kruskal_tests(df, group, [column]).drop("variable")


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-group numbers; a missing group key matches itself."""
    from kohorta.operators.keyed import join_null_safe

    if not keys:  # one row on the right: a scalar subquery
        return left.withColumn("_r", right.select(F.struct(*right.columns)).scalar()).select(
            *left.columns, "_r.*"
        )
    return join_null_safe(left, right, list(keys), "inner")
