"""Query registry: each query is a Spark function and, where SQL can say it, its twin."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohorta.plans.views import VIEWS, Clinic
from kohorta.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_last: list[tuple[SparkSession, str, Clinic]] = []


def clinic(spark: SparkSession, sf_dir: str) -> Clinic:
    """The views over a folder; those of the last session and folder are kept, so that
    a run of many queries analyses each view once.  Plans only, no data."""
    if not _last or _last[0][0] is not spark or _last[0][1] != sf_dir:
        _last[:] = [(spark, sf_dir, Clinic(spark, sf_dir))]
    return _last[0][2]


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(clinic) -> DataFrame`` under its own name."""

    def add(fn):
        label = name or fn.__name__.rstrip("_")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(clinic(configure(spark), sf_dir)))

        QUERIES[label] = run
        if sql is not None:
            SQL[label] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Put the views a statement names in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if not views:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"


def present(df: DataFrame) -> DataFrame:
    """Plain output types: dates and times as text, whole numbers long, doubles rounded."""
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            col = col.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.round(col.cast("double"), 6)
        out.append(col.alias(f.name))
    return df.select(*out)
