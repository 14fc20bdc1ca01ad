"""Concordance of a risk score with survival by dominance counting: no pair of subjects is ever formed.

A pair is comparable where one has its event before the other's time (an event also comes before a censoring of the same
day).  It is concordant where the earlier one has the higher score.  Subjects are counted per (time, event, score), and the
counts lie in ranges of the score.  Pairs of different ranges need only the counts per (time, range); they are counted in two
levels of at most ``FAN`` ranges each, pairs within a range on its own rows.  All three levels are the same counting of
dominated points (``dominance``), by merging runs of later and earlier times sorted by score.

Rows of a task: days x ``FAN`` on the upper levels; on the lowest the rows of one range, about ``RANGE_ROWS`` where the number
of ranges allows it (``FAN`` squared at most).  A score shared by many subjects is one row per time and event.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.session import settle

FAN = 64
RANGE_ROWS = 50_000
BLOCK = 128


def dominance(u: np.ndarray, score: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[float, float, float]:
    """Weighted pairs (d of a row, n of a row with larger ``u``) whose score is lower, higher or equal."""
    low = high = equal = 0.0
    order = np.argsort(-u, kind="stable")
    todo = [tuple(v[order] for v in (u, score, n, d))]
    while todo:
        u, score, n, d = todo.pop()
        if len(u) < 2 or u[0] == u[-1] or not d.any():
            continue
        if len(u) <= BLOCK:
            later = u[None, :] > u[:, None]
            pairs = d[:, None] * n[None, :] * later
            less, more = score[None, :] < score[:, None], score[None, :] > score[:, None]
            low, high = low + float(pairs[less].sum()), high + float(pairs[more].sum())
            equal += float(pairs[~less & ~more].sum())
            continue
        cut = int(np.searchsorted(-u, -u[len(u) // 2], side="left")) or int(np.searchsorted(-u, -u[len(u) // 2], side="right"))
        run = np.argsort(score[:cut], kind="stable")  # later times, sorted by score, with running counts
        ranked, below = score[:cut][run], np.concatenate(([0.0], np.cumsum(n[:cut][run], dtype=float)))
        left, right = (below[np.searchsorted(ranked, score[cut:], side=s)] for s in ("left", "right"))
        low += float((d[cut:] * left).sum())
        equal += float((d[cut:] * (right - left)).sum())
        high += float((d[cut:] * (below[-1] - right)).sum())
        todo += [tuple(v[:cut] for v in (u, score, n, d)), tuple(v[cut:] for v in (u, score, n, d))]
    return low, high, equal


def concordance(df: DataFrame, score: Column, time: str = "t_days", event: str = "event", ranges: int | None = None) -> DataFrame:
    """One row ``concordant, discordant, tied, concordance`` over the complete rows; null without a comparable pair."""
    rows = df.select(
        (2 * F.col(time).cast("long") + F.when(F.col(event) == 1, 0).otherwise(1)).alias("u"),
        score.cast("double").alias("score"), F.col(event).alias("e"),
    ).dropna()
    d = F.sum(F.when(F.col("e") == 1, 1.0).otherwise(0.0)).alias("d")
    counts = settle(rows.groupBy("u", "score").agg(F.sum(F.lit(1.0)).alias("n"), d), "scores")
    ranges = ranges or min(FAN * FAN, 1 + counts.count() // RANGE_ROWS)
    ranged = counts.repartitionByRange(ranges, "score").withColumn("r", F.spark_partition_id())
    ranged = settle(ranged, "score-ranges")
    both = [F.sum("n").alias("n"), F.sum("d").alias("d")]
    level = lambda k, group, child: ranged.groupBy(F.lit(k).alias("level"), group.alias("part"), "u", child.cast("double").alias("score")).agg(*both)
    whole, high, low = F.lit(0), F.floor(F.col("r") / FAN).cast("int"), F.col("r")
    points = ranged.select(F.lit(2).alias("level"), low.alias("part"), "u", "score", "n", "d")
    if ranges > 1:
        points = points.unionByName(level(1, high, low))
    if ranges > FAN:
        points = points.unionByName(level(0, whole, high))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        less, more, same = dominance(*(pdf[c].to_numpy() for c in ("u", "score", "n", "d")))
        return pd.DataFrame({"concordant": [less], "discordant": [more], "tied": [same if key[0] == 2 else 0.0]})

    found = points.groupBy("level", "part").applyInPandas(run, "concordant double, discordant double, tied double")
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("concordant", "discordant", "tied")))
    pairs = F.col("concordant") + F.col("discordant") + F.col("tied")
    return sums.withColumn("concordance", F.when(pairs > 0, (F.col("concordant") + F.col("tied") / 2) / pairs))
