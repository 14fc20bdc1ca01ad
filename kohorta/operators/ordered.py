"""Order-dependent columns for event sequences of any length.

A window over a subject would gather all its rows in one task.  Here a subject's
rows are cut into calendar chunks.  Windows run inside (subject, chunk); what has
to cross a chunk border is carried by one summary row per (subject, chunk), and
the number of those is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Carry:
    """One order-dependent column.

    kind: ``lag`` (value of the previous row), ``down`` (last non-null value up to
    this row), ``up`` (first non-null value from this row on), ``number`` (row
    number) or ``running`` (running sum).
    """

    kind: str
    value: Column | None = None


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: dict[str, Carry],
) -> DataFrame:
    """Add order-dependent columns.  ``chunk`` must rise with ``order``."""
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    for name, c in columns.items():
        if c.kind != "number":
            base = base.withColumn(f"_v_{name}", c.value)

    rank = F.struct(*order)
    edges = []
    for name, c in columns.items():
        value = F.col(f"_v_{name}")
        boxed = F.struct(value.alias("v"))
        if c.kind == "lag":
            edges.append(F.max_by(boxed, rank).alias(f"_e_{name}"))
        elif c.kind == "down":
            edges.append(F.max_by(boxed, F.when(value.isNotNull(), rank)).alias(f"_e_{name}"))
        elif c.kind == "up":
            edges.append(F.min_by(boxed, F.when(value.isNotNull(), rank)).alias(f"_e_{name}"))
        elif c.kind == "number":
            edges.append(F.count(F.lit(1)).alias(f"_e_{name}"))
        elif c.kind == "running":
            edges.append(F.sum(value).alias(f"_e_{name}"))
        else:
            raise ValueError(f"unknown kind {c.kind!r}")
    summary = base.groupBy(*keys, "_chunk").agg(*edges)

    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.rowsBetween(1, Window.unboundedFollowing)
    borders = []
    for name, c in columns.items():
        edge = F.col(f"_e_{name}")
        if c.kind == "lag":
            borders.append(F.lag(edge).over(chunks).alias(f"_b_{name}"))
        elif c.kind == "down":
            borders.append(F.last(edge, ignorenulls=True).over(earlier).alias(f"_b_{name}"))
        elif c.kind == "up":
            borders.append(F.first(edge, ignorenulls=True).over(later).alias(f"_b_{name}"))
        else:
            borders.append(F.coalesce(F.sum(edge).over(earlier), F.lit(0)).alias(f"_b_{name}"))
    summary = summary.select(*keys, "_chunk", *borders)

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = base.join(summary, [*keys, "_chunk"])
    added = []
    for name, c in columns.items():
        border = F.col(f"_b_{name}")
        value = F.col(f"_v_{name}")
        boxed = F.struct(value.alias("v"))
        present = F.when(value.isNotNull(), boxed)
        if c.kind == "lag":
            added.append(F.coalesce(F.lag(boxed).over(inside), border)["v"].alias(name))
        elif c.kind == "down":
            added.append(F.coalesce(F.last(present, ignorenulls=True).over(so_far), border)["v"].alias(name))
        elif c.kind == "up":
            added.append(F.coalesce(F.first(present, ignorenulls=True).over(onward), border)["v"].alias(name))
        elif c.kind == "number":
            added.append((F.row_number().over(inside) + border).alias(name))
        else:
            added.append((F.coalesce(F.sum(value).over(so_far), F.lit(0)) + border).alias(name))
    kept = [c for c in df.columns if c not in columns]
    return out.select(*kept, *added)


def fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, column: str, up: bool = False
) -> DataFrame:
    """Fill missing values from the previous (or following) row that has one."""
    return carry(df, keys, order, chunk, {column: Carry("up" if up else "down", F.col(column))})
