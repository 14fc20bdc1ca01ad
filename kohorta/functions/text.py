"""String cleaning and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Junk found in dispensing codes, and codes that stand for "no code".
CODE_JUNK = [":|_|\u008f\u008f|ÅÅ|XXX", "Å"]
VOID_CODES = ["N/A", "NUL", "", "X"]


def clean_code(code: Column, junk: list[str] = CODE_JUNK) -> Column:
    """Remove junk substrings, one pass per pattern and in the order given."""
    for pattern in junk:
        code = F.regexp_replace(code, pattern, "")
    return code


def decimal_comma(text: Column) -> Column:
    """Text with a decimal comma (or point) to double; null when it is no number."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def lab_number(text: Column) -> Column:
    """First number of a free-text laboratory answer (``<4,0`` and ``ca. 12`` included)."""
    found = F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)", 1)
    return decimal_comma(found)


def p_text(p: Column, digits: int = 3) -> Column:
    """Fixed-point text of a p-value; a text of all zeros becomes ``<0.001``."""
    text = F.format_string(f"%.{digits}f", F.round(p, digits))
    zero = f"{0:.{digits}f}"
    floor = "<" + zero[:-1] + "1"
    return F.when(p.isNull(), F.lit(None)).when(text == zero, F.lit(floor)).otherwise(text)


def interval_parts(text: Column) -> tuple[Column, Column]:
    """Bounds of an ``[a;b]`` text as doubles."""
    halves = F.split(F.regexp_replace(text, r"[\[\]]", ""), ";")
    return halves.getItem(0).try_cast("double"), halves.getItem(1).try_cast("double")


def small_cell(n: Column, limit: int = 5) -> Column:
    """Count as text, small counts hidden."""
    return F.when(n < limit, F.lit(f"<{limit}")).otherwise(n.cast("string"))
