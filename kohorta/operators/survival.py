"""Kaplan-Meier and log-rank from per-day counts.

Subjects shrink to counts per (stratum, day) in one aggregate; every ordered step
then runs over at most as many rows as there are days of follow-up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions.tails import chi_square_upper

Z95 = 1.959963984540054


def _part(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def day_counts(df: DataFrame, strata: Sequence[str], time: str, event: str) -> DataFrame:
    """``strata, t, n, d``: subjects leaving and events per day (null times drop out)."""
    return (
        df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
        .groupBy(*strata, F.col(time).alias("t"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("d"))
    )


def kaplan_meier(df: DataFrame, strata: Sequence[str], time: str = "t_days", event: str = "event") -> DataFrame:
    """Survival curve per stratum, one row per day with an exit: numbers at risk, events,
    survival, Greenwood standard error, 95% limits on the log scale and ``1 - survival``."""
    counts = day_counts(df, strata, time, event)
    back = Window.partitionBy(*_part(strata)).orderBy(F.col("t").desc())
    ahead = (
        Window.partitionBy(*_part(strata))
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at_risk = F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n, d = F.col("n_risk"), F.col("d")
    out = counts.withColumn("n_risk", at_risk).select(
        *strata,
        "t",
        "n_risk",
        F.col("d").alias("n_event"),
        (F.col("n") - d).alias("n_censor"),
        F.product(1 - d / n).over(ahead).alias("survival"),
        F.sum(F.when(n > d, d / (n * (n - d)))).over(ahead).alias("_g"),
    )
    s = F.col("survival")
    width = F.sqrt("_g") * Z95
    alive = s > 0
    return out.select(
        *strata,
        "t",
        "n_risk",
        "n_event",
        "n_censor",
        "survival",
        F.when(alive, s * F.sqrt("_g")).alias("std_err"),
        F.when(alive, s * F.exp(-width)).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), s * F.exp(width))).alias("upper"),
        (1 - s).alias("incidence"),
    )


def on_grid(
    curve: DataFrame, df: DataFrame, strata: Sequence[str], grid: Sequence[int], time: str = "t_days"
) -> DataFrame:
    """Survival (last step up to the grid day) and numbers at risk on a day grid."""
    days = F.explode(F.array(*[F.lit(int(g)) for g in grid]))
    steps = (
        curve.select(*strata, "t", "survival", days.alias("grid_day"))
        .where(F.col("t") <= F.col("grid_day"))
        .groupBy(*strata, "grid_day")
        .agg(F.max_by("survival", "t").alias("survival"))
    )
    still = (
        df.where(F.col(time).isNotNull())
        .groupBy(*strata)
        .agg(*[F.count(F.when(F.col(time) >= int(g), 1)).alias(f"{int(g)}") for g in grid])
        .unpivot([*strata], [f"{int(g)}" for g in grid], "grid_day", "n_risk")
        .withColumn("grid_day", F.col("grid_day").cast("int"))
    )
    return still.join(steps, [*strata, "grid_day"], "left").fillna(1.0, subset=["survival"])


def logrank(
    df: DataFrame,
    group: str,
    levels: Sequence[str],
    by: Sequence[str] = (),
    time: str = "t_days",
    event: str = "event",
) -> DataFrame:
    """Log-rank test of K groups, one row per ``by`` value: ``chi_square, dof, p`` and
    observed and expected events per group."""
    k = len(levels)
    counts = day_counts(df.where(F.col(group).isin(list(levels))), [*by, group], time, event)
    wide = counts.groupBy(*by, "t").agg(
        *[F.sum(F.when(F.col(group) == v, F.col("n")).otherwise(0)).alias(f"n{i}") for i, v in enumerate(levels)],
        *[F.sum(F.when(F.col(group) == v, F.col("d")).otherwise(0)).alias(f"d{i}") for i, v in enumerate(levels)],
    )
    back = (
        Window.partitionBy(*_part(by))
        .orderBy(F.col("t").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    risk = wide.select(
        *by,
        *[F.col(f"d{i}").cast("double").alias(f"d{i}") for i in range(k)],
        *[F.sum(f"n{i}").over(back).cast("double").alias(f"r{i}") for i in range(k)],
    )
    d = sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0"))
    n = sum((F.col(f"r{i}") for i in range(1, k)), F.col("r0"))
    risk = risk.withColumns({"d": d, "n": n}).where(F.col("d") > 0)
    d, n = F.col("d"), F.col("n")
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    aggs = []
    for i in range(k):
        share = F.col(f"r{i}") / n
        aggs += [F.sum(f"d{i}").alias(f"observed{i}"), F.sum(d * share).alias(f"expected{i}")]
        for j in range(i, k):
            same = F.lit(1.0 if i == j else 0.0)
            aggs.append(F.sum(spread * share * (same - F.col(f"r{j}") / n)).alias(f"v{i}_{j}"))
    sums = risk.groupBy(*by).agg(*aggs) if by else risk.agg(*aggs)
    keep = [*by, *[f"observed{i}" for i in range(k)], *[f"expected{i}" for i in range(k)]]
    schema = sums.select(
        *keep,
        F.lit(0.0).alias("chi_square"),
        F.lit(0).alias("dof"),
        F.lit(0.0).cast("double").alias("p"),
    ).schema
    for f in schema.fields[-3:]:
        f.nullable = True

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for r in rows.to_dict("records"):
                live = [i for i in range(k) if (r[f"expected{i}"] or 0) > 0]
                diff = np.array([r[f"observed{i}"] - r[f"expected{i}"] for i in live])[:-1]
                var = np.array(
                    [[r[f"v{min(i, j)}_{max(i, j)}"] for j in live] for i in live]
                )[:-1, :-1]
                dof = len(live) - 1
                stat = float(diff @ np.linalg.pinv(var) @ diff) if dof > 0 else None
                done.append(
                    {c: r[c] for c in keep}
                    | {"chi_square": stat, "dof": dof, "p": chi_square_upper(stat, dof)}
                )
            yield pd.DataFrame(done, columns=schema.names)

    return sums.mapInPandas(solve, schema)


