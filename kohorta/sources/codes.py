"""Code lists and weight tables as small frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def small_frame(
    spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str], types: Sequence[str] | None = None
) -> DataFrame:
    """A literal table; it reaches the plan as a local relation of known size.

    ``types`` (string, long, double) are needed where a column may be empty.
    """
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [_TYPES[t] for t in types] if types else [None] * len(names)
    arrays = [pa.array(list(c), type=k) for c, k in zip(columns, kinds)]
    return spark.createDataFrame(pa.table(dict(zip(names, arrays))))


def code_list(spark: SparkSession, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(list_name, code, rung)``; ``rung`` is the place of the list in the mapping."""
    rows = [
        (name, code, rung)
        for rung, (name, codes) in enumerate(lists.items())
        for code in dict.fromkeys(codes)
    ]
    return small_frame(spark, rows, ["list_name", "code", "rung"])


def expand_codes(spec: str) -> list[str]:
    """``"I60-I69 G45"`` to single codes; a range runs over the last digits."""
    out: list[str] = []
    for item in spec.split():
        if "-" not in item:
            out.append(item)
            continue
        first, last = item.split("-")
        head = first[:1]
        width = len(first) - 1
        out += [f"{head}{n:0{width}d}" for n in range(int(first[1:]), int(last[1:]) + 1)]
    return out


# Charlson groups with ICD-10 prefixes (Quan et al., Med Care 2005),
# the 1987 weights and the 2011 update (Quan et al., Am J Epidemiol 2011).
# (group, prefixes, weight 1987, weight 2011)
CHARLSON = [
    ("CHF", "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290", 1, 2),
    ("Dementia", "F00-F03 F051 G30 G311", 1, 2),
    ("CPD", "I278 I279 J40-J47 J60-J67 J684 J701 J703", 1, 1),
    ("Rheumatic", "M05 M06 M315 M32-M34 M351 M353 M360", 1, 1),
    ("Liver_Mild", "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944", 1, 2),
    ("Hemiplegia", "G041 G114 G801 G802 G81 G82 G830-G834 G839", 2, 2),
    ("Renal", "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992", 2, 1),
    ("DM_w_compl", "E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147", 2, 1),
    ("Cancer_and_Hem", "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97", 2, 2),
    ("Liver_Severe", "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767", 3, 4),
    ("Cancer_Metastatic", "C77-C80", 6, 6),
    ("AIDS", "B20-B22 B24", 6, 4),
]


def charlson_weights(prefix: str = "") -> list[tuple[str, str, int, int]]:
    """``(group, code prefix, weight 1987, weight 2011)``; ``prefix`` is put before
    each code for registers that write, say, ``DI50`` for ``I50``."""
    return [
        (group, prefix + code, w1987, w2011)
        for group, spec, w1987, w2011 in CHARLSON
        for code in expand_codes(spec)
    ]


# The five groups of the 1987 index (Charlson et al., J Chronic Dis 1987; codes of Quan et al., Med Care 2005)
# that the 2011 update leaves without weight.
CHARLSON_1987_MORE = [
    ("MI", "I21 I22 I252", 1),
    ("PVD", "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959", 1),
    ("CVD", "G45 G46 H340 I60-I69", 1),
    ("PUD", "K25-K28", 1),
    ("DM", "E100 E101 E106 E108-E111 E116 E118-E121 E126 E128-E131 E136 E138-E141 E146 E148 E149", 1),
]
CHARLSON_SEVERE = {"Liver_Mild": ["Liver_Severe"], "Cancer_and_Hem": ["Cancer_Metastatic"], "DM": ["DM_w_compl"]}


def charlson_1987(prefix: str = "") -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(code prefix, group) and the weight of each of the 17 groups of the 1987 index."""
    groups = [*((g, spec, w) for g, spec, w, _ in CHARLSON), *CHARLSON_1987_MORE]
    return [(prefix + c, g) for g, spec, _ in groups for c in expand_codes(spec)], {g: w for g, _, w in groups}
