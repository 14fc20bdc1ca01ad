"""Multiplicity correction and publication tables of a screen (one row per class)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions.text import p_text, small_cell

# Descriptions that replace the dictionary's.
NAME_OVERRIDES = {
    "A07": "antidiarrheals, intestinal antiinflammatory",
    "G03": "sex hormones and genital modulators",
}


def adjust_p(df: DataFrame, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Add ``fdr`` (Benjamini-Hochberg) and ``bonferroni``; missing p-values stay out of
    the number of tests.  The table has one row per tested class."""
    part = list(by) if by else [F.lit(0)]
    up = Window.partitionBy(*part, F.col(p).isNull()).orderBy(p)
    down = Window.partitionBy(*part, F.col(p).isNull()).orderBy(F.col(p).desc())
    m = F.count(p).over(Window.partitionBy(*part))
    rank = F.count(F.lit(1)).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumns({"_m": m, "_rank": rank})
        .withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
        .withColumns(
            {
                "fdr": F.when(
                    F.col(p).isNotNull(),
                    F.least(
                        F.lit(1.0),
                        F.min("_q").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
                    ),
                ),
                "bonferroni": F.when(
                    F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m"))
                ),
            }
        )
        .drop("_m", "_rank", "_q")
    )


def significant(df: DataFrame, alpha: float = 0.05, drop_degenerate: bool = True) -> DataFrame:
    """Classes below the Bonferroni level; hazard ratios that print as 0.00 leave."""
    out = df.where(F.col("bonferroni") < alpha)
    return out.where(F.round("hr", 2) != 0) if drop_degenerate else out


def described(
    df: DataFrame,
    dictionary: DataFrame,
    overrides: Mapping[str, str] = NAME_OVERRIDES,
    require_name: bool = False,
) -> DataFrame:
    """Class names from the code dictionary (``atc3, name``), with overrides."""
    out = df.join(dictionary, "atc3", "left")
    if require_name:
        out = out.where(F.col("name").isNotNull())
    name: Column = F.col("name")
    for code, text in overrides.items():
        name = F.when(F.col("atc3") == code, F.lit(text)).otherwise(name)
    return out.withColumn("name", name)


def printed(df: DataFrame, min_cell: int = 5) -> DataFrame:
    """Count, hazard ratio and corrected p-values as text."""
    return df.select(
        "atc3",
        small_cell(F.col("n"), min_cell).alias("n"),
        F.format_string("%.2f [%.2f;%.2f]", "hr", "lower", "upper").alias("hr_text"),
        p_text(F.col("bonferroni")).alias("p_text"),
    )


def result_table(outcomes: Mapping[str, DataFrame], dictionary: DataFrame) -> DataFrame:
    """Printed screens side by side: full join on the class, count from the first
    outcome that has one besides the leading outcome."""
    names = list(outcomes)
    out = None
    for o in names:
        cols = outcomes[o].select(
            "atc3",
            F.col("n").alias(f"n_{o}"),
            F.col("hr_text").alias(f"hr_{o}"),
            F.col("p_text").alias(f"p_{o}"),
        )
        out = cols if out is None else out.join(cols, "atc3", "full")
    if len(names) > 2:
        second = names[1]
        out = out.withColumn(f"n_{second}", F.coalesce(*[f"n_{o}" for o in names[1:]]))
        out = out.drop(*[f"n_{o}" for o in names[2:]])
    out = described(out, dictionary, {})
    return out.select("atc3", "name", *[c for c in out.columns if c not in ("atc3", "name")])
