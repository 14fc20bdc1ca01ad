"""Code prefixes as half-open ranges in one sorted array: one rule for any number of prefixes and lengths.

The codes that start with a prefix are those from the prefix up to its successor.  The ends of all ranges cut the codes
into elementary ranges, and each carries the labels of the prefixes around it, so a code is placed by one binary
search.  Only distinct codes are placed; events are joined to them by equality.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PrefixRanges:
    """Labels by code prefix; an empty prefix holds for every code."""

    def __init__(self, entries: Sequence[tuple[str, str]]) -> None:
        ranges = [(p, p[:-1] + chr(ord(p[-1]) + 1) if p else None, name) for p, name in entries]
        self.cuts = sorted({"", *(r[0] for r in ranges), *(r[1] for r in ranges if r[1] is not None)})
        self.found = []
        for at in self.cuts:
            around = [(len(low), name) for low, high, name in ranges if low <= at and (high is None or at < high)]
            self.found.append([name for _, name in sorted(around, key=lambda r: -r[0])])

    def labels(self, code: str | None) -> list[str]:
        """Distinct labels of the prefixes of a code, longest prefix first."""
        if code is None:
            return []
        return list(dict.fromkeys(self.found[bisect.bisect_right(self.cuts, code) - 1]))


def with_prefix_labels(
    events: DataFrame, code: str, entries: Sequence[tuple[str, str]], name: str, longest: bool = False
) -> DataFrame:
    """Events with the label of a listed prefix of their code: a row for each label, or that of the longest prefix only.
    Events without one drop out."""
    ranges = PrefixRanges(entries)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, label) for c in batch["_code"] for label in ranges.labels(c)[: 1 if longest else None]]
            yield pd.DataFrame(rows, columns=["_code", name])

    codes = events.where(F.col(code).isNotNull()).select(F.col(code).alias("_code")).distinct()
    placed = codes.mapInPandas(place, f"_code string, `{name}` string")
    return events.join(placed, F.col(code) == F.col("_code")).drop("_code")


def prefix_mask(code: Column, entries: Sequence[tuple[str, str]], labels: Sequence[str]) -> Column:
    """Bit ``i`` of the result is set where a prefix of ``labels[i]`` starts the code; null where none does.

    For events that are looked at in passing: no join and no second scan for the distinct codes.  The leading characters
    are looked up in one literal map per prefix length, so the cost of a row grows with the number of listed prefixes.
    """
    if len(labels) > 63:
        raise ValueError("a mask holds up to 63 labels")
    bit = {name: 1 << i for i, name in enumerate(labels)}
    by_length: dict[int, dict[str, int]] = {}
    for prefix, name in entries:
        masks = by_length.setdefault(len(prefix), {})
        masks[prefix] = masks.get(prefix, 0) | bit[name]
    found = []
    for length, masks in sorted(by_length.items()):
        table = F.create_map(*[F.lit(x) for p, m in masks.items() for x in (p, F.lit(m).cast("long"))])
        found.append(F.coalesce(F.try_element_at(table, F.left(code, F.lit(length))), F.lit(0).cast("long")))
    return F.nullif(reduce(Column.bitwiseOR, found), F.lit(0).cast("long"))
