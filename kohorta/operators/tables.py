"""Frequency tables, baseline tables, cohort flow and date coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.operators.distribution import kruskal_tests, quantiles_of_counts
from kohorta.operators.keyed import join_null_safe, union_all
from kohorta.sources.codes import small_frame

TOTAL = "Total"


def frequency(df: DataFrame, column: str, with_null: bool = True) -> DataFrame:
    """Count per value; the missing value is a level unless ``with_null`` is off."""
    kept = df if with_null else df.where(F.col(column).isNotNull())
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Two-way counts, one column per level."""
    return df.groupBy(row).agg(
        *[F.count(F.when(F.col(column) == v, 1)).alias(f"{v}") for v in levels],
        F.count(F.lit(1)).alias("total"),
    )


def chi_square(df: DataFrame, by: str, factors: Sequence[str]) -> DataFrame:
    """Pearson statistic of ``by`` against each factor: ``variable, statistic, dof, n``.

    Works on the contingency counts; empty cells enter through the margins, as the sum
    of observed squared over expected needs observed cells only.
    """
    cells = _level_counts(df.where(F.col(by).isNotNull()), by, factors).where(F.col("level").isNotNull())
    rows = cells.groupBy("variable", "stratum").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("variable", "level").agg(F.sum("n").alias("c"))
    whole = cells.groupBy("variable").agg(F.sum("n").alias("total"))
    return (
        cells.join(rows, ["variable", "stratum"])
        .join(cols, ["variable", "level"])
        .join(whole, "variable")
        .groupBy("variable")
        .agg(
            F.sum(F.col("n").cast("double") * F.col("n") / F.col("r") / F.col("c")).alias("q"),
            F.max("total").alias("n"),
            F.count_distinct("stratum").alias("k"),
            F.count_distinct("level").alias("l"),
        )
        .select(
            "variable",
            (F.col("n") * (F.col("q") - 1)).alias("statistic"),
            ((F.col("k") - 1) * (F.col("l") - 1)).alias("dof"),
            "n",
        )
    )


def _level_counts(df: DataFrame, by: str, factors: Sequence[str]) -> DataFrame:
    """Counts per (variable, level, stratum), from one pass with map-side combine."""
    pieces = [
        F.struct(F.lit(f).alias("variable"), F.col(f).cast("string").alias("level")) for f in factors
    ]
    return (
        df.select(F.col(by).cast("string").alias("stratum"), F.explode(F.array(*pieces)).alias("p"))
        .groupBy("p.variable", "p.level", "stratum")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def baseline_table(
    df: DataFrame,
    by: str,
    medians: Sequence[str] = (),
    means: Sequence[str] = (),
    factors: Sequence[str] = (),
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Characteristics per stratum and in total, long form.

    Rows ``variable, level, stratum``; factors give ``n`` and ``pct`` of the stratum's
    known values, ``medians`` give ``median, q1, q3``, ``means`` give ``mean, sd``.  The
    total comes from the same pass as the strata.  A factor with a level list in
    ``levels`` shows its empty levels too.
    """
    parts = []
    if factors:
        cells = _level_counts(df, by, factors)
        total = cells.groupBy("variable", "level").agg(F.sum("n").alias("n")).withColumn("stratum", F.lit(TOTAL))
        cells = cells.where(F.col("stratum").isNotNull()).unionByName(total)
        known = (
            cells.where(F.col("level").isNotNull())
            .groupBy("variable", "stratum")
            .agg(F.sum("n").alias("_m"))
        )
        if levels:
            listed = small_frame(
                df.sparkSession, [(v, x) for v, names in levels.items() for x in names], ["variable", "level"]
            )
            wanted = known.select("variable", "stratum").join(listed, "variable")
            cells = cells.join(wanted, ["variable", "level", "stratum"], "full").fillna(0, subset=["n"])
        parts.append(
            cells.join(known, ["variable", "stratum"], "left").withColumn(
                "pct", F.when(F.col("level").isNotNull(), 100.0 * F.col("n") / F.col("_m"))
            ).drop("_m")
        )
    if medians:
        counts = (
            df.select(F.col(by).cast("string").alias("stratum"), *[F.col(c).cast("double") for c in medians])
            .unpivot(["stratum"], list(medians), "variable", "x")
            .where(F.col("x").isNotNull())
            .select("variable", F.explode(F.array("stratum", F.lit(TOTAL))).alias("stratum"), "x", F.lit(1).cast("long").alias("n"))
            .where(F.col("stratum").isNotNull())
        )
        keys = ["variable", "stratum"]
        parts.append(quantiles_of_counts(counts, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], total="n"))
    if means:
        long = (
            df.select(F.col(by).cast("string").alias("stratum"), *[F.col(c).cast("double") for c in means])
            .unpivot(["stratum"], list(means), "variable", "x")
            .withColumn("stratum", F.explode(F.array("stratum", F.lit(TOTAL))))
            .where(F.col("stratum").isNotNull())
        )
        parts.append(
            long.groupBy("variable", "stratum").agg(
                F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n")
            )
        )
    columns = ["variable", "level", "stratum", "n", "pct", "median", "q1", "q3", "mean", "sd"]
    out = []
    for part in parts:
        missing = {
            c: F.lit(None).cast("string" if c == "level" else "double")
            for c in columns
            if c not in part.columns
        }
        out.append(part.withColumns(missing).select(*columns))
    return union_all(out)


def printed_baseline(table: DataFrame, strata: Sequence[str], only_level: str | None = None) -> DataFrame:
    """Baseline table as text, one column per stratum: ``n (%)``, ``median [q1;q3]`` or
    ``mean (sd)``."""
    rows = table if only_level is None else table.where(F.col("level") == only_level)
    text = (
        F.when(F.col("median").isNotNull(), F.format_string("%.1f [%.1f;%.1f]", "median", "q1", "q3"))
        .when(F.col("mean").isNotNull(), F.format_string("%.1f (%.1f)", "mean", "sd"))
        .otherwise(F.format_string("%d (%.1f)", F.col("n").cast("long"), F.coalesce("pct", F.lit(0.0))))
    )
    return (
        rows.groupBy("variable", "level")
        .pivot("stratum", [*strata, TOTAL])
        .agg(F.first(text))
    )


def group_tests(df: DataFrame, by: str, medians: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """Test statistic per variable: Kruskal-Wallis for medians, chi-square for factors."""
    parts = []
    if factors:
        parts.append(chi_square(df, by, factors).withColumn("test", F.lit("chi-square")))
    if medians:
        parts.append(kruskal_tests(df, by, medians).withColumn("test", F.lit("kruskal-wallis")))
    return union_all(parts)


def cohort_flow(steps: Mapping[str, DataFrame], key: str = "patientid", by: str | None = None) -> DataFrame:
    """Rows and subjects per named step and the subjects lost since the step before.

    Steps are small summaries by then: one row per step (and group).
    """
    names = list(steps)
    groups = [by] if by else []
    counts = []
    for i, name in enumerate(names):
        step = steps[name]
        agg = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_patients")]
        one = step.groupBy(*groups).agg(*agg) if groups else step.agg(*agg)
        counts.append(one.select(*groups, F.lit(i).alias("step_no"), F.lit(name).alias("step"), "n_rows", "n_patients"))
    table = union_all(counts)
    before = table.select(*groups, (F.col("step_no") + 1).alias("step_no"), F.col("n_patients").alias("_p"))
    joined = join_null_safe(table, before, [*groups, "step_no"], "left")
    return joined.withColumn("n_excluded", F.col("_p") - F.col("n_patients")).drop("_p")


def date_histogram(df: DataFrame, date: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of dates: ``bin`` (1..bins), first day, rows.

    Days are counted first; edges come from the range as a scalar subquery.
    """
    per_day = df.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi"))).scalar()
    number = F.least(
        F.lit(bins),
        1 + F.floor(
            F.date_diff(F.col("day"), F.col("_s.lo"))
            * F.lit(bins)
            / F.greatest(F.lit(1), F.date_diff(F.col("_s.hi"), F.col("_s.lo")))
        ),
    )
    return (
        per_day.withColumn("_s", span)
        .groupBy(number.cast("int").alias("bin"))
        .agg(F.min("day").alias("first_day"), F.sum("n").alias("n"))
    )
