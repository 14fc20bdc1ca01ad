"""Declarative cleaning of raw registers, and tables derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.bins import recode
from kohorta.functions.dates import diff_years
from kohorta.functions.text import lab_number
from kohorta.operators.keyed import first_per_key, union_all


@dataclass(frozen=True)
class Field:
    """How one clean column comes from the raw table."""

    source: str
    type: str | None = None
    labels: Mapping[str, str] | None = None
    void: Sequence[str] = ()

    def expr(self) -> Column:
        col = F.col(self.source)
        if self.void:
            col = F.when(~F.coalesce(col.isin(list(self.void)), F.lit(False)), col)
        if self.labels:
            col = recode(col, self.labels)
        if self.type == "date":
            return col.cast("date")
        return col.try_cast(self.type) if self.type else col


# First-line response labels.
RESPONSE_LABELS = {
    "CMR with residual mass": "CR",
    "Cru": "CR",
    "CMR and CR": "CR",
    "PR": "PR",
    "SD": "SD",
    "PD": "PD",
    "mors": "death",
}
RESPONSE_VOID = ("UNK", "not_performed")


def clean_register(raw: DataFrame, spec: Mapping[str, Field]) -> DataFrame:
    """Rename, void, recode and cast; unnamed columns are dropped."""
    return raw.select(*[f.expr().alias(name) for name, f in spec.items()])


def clean_lab_values(labs: DataFrame, raw: str = "value", clean: str = "value2") -> DataFrame:
    """Numeric value of free-text answers, null where there is no number."""
    return labs.withColumn(clean, lab_number(F.col(raw)))


def hospital_per_subject(registers: Sequence[DataFrame], key: str = "patientid") -> DataFrame:
    """One hospital per subject over all registers: the smallest id wins, nulls last."""
    rows = union_all([r.select(key, "hospital_id") for r in registers])
    return first_per_key(rows, [key], ["hospital_id"])


def clean_response(raw: Column) -> Column:
    void = F.coalesce(raw.isin(list(RESPONSE_VOID)), F.lit(False))
    return recode(F.when(~void, raw), RESPONSE_LABELS)


def time_to_next_treatment(
    df: DataFrame, start: str, second_line: str, end: str = "date_death_fu", name: str = "time_treatment_2nd_line"
) -> DataFrame:
    """Years from first-line treatment to second line, else to death or end of follow-up."""
    stop = F.coalesce(F.col(second_line), F.col(end))
    return df.withColumns(
        {
            "date_treatment_2nd_line_death": stop,
            name: diff_years(F.col(start), stop),
        }
    )


def corrected_death(df: DataFrame, index: str, death: str, last_seen: str) -> Column:
    """Last known date in place of a death dated before the index."""
    return F.when(F.col(death) < F.col(index), F.col(last_seen)).when(
        F.col(death).isNotNull() & F.col(index).isNotNull(), F.col(death)
    )
