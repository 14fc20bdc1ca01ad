"""Right-closed bins, two-level labels, recodes and level order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Medication-count bins and comorbidity bins of the study.
DRUG_COUNT_CUTS = ([3, 7, 11], ["0-3", "4-7", "8-11", ">11"])
COMORBIDITY_CUTS = ([2], ["0-2", ">2"])
PROGNOSTIC_LEVELS = ["Low", "Intermediate", "High", "Very high"]


def cut(col: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(-inf, b1], (b1, b2], ... (bk, inf)``; null stays null."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("need one label more than inner breaks")
    expr = F.when(col.isNull(), F.lit(None))
    for bound, label in zip(breaks, labels):
        expr = expr.when(col <= bound, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def at_least(col: Column, threshold: float, no="No", yes="Yes") -> Column:
    """``no`` below the threshold, ``yes`` from it on; null stays null."""
    return F.when(col.isNull(), F.lit(None)).when(col < threshold, F.lit(no)).otherwise(F.lit(yes))


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    expr = None
    for old, new in mapping.items():
        expr = F.when(col == old, F.lit(new)) if expr is None else expr.when(col == old, F.lit(new))
    return col if expr is None else expr.otherwise(col)


def as_level(col: Column, levels: Sequence) -> Column:
    """The value when it is one of the levels, else null."""
    return F.when(col.isin(list(levels)), col)


def level_rank(col: Column, levels: Sequence) -> Column:
    """1-based position in the level list; null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), col), F.lit(0)).cast("int")
