"""Column expressions shared by the operators; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_letter(col: Column) -> Column:
    """First letter of a link type, leading blanks and case aside; null for a null, empty or blank type."""
    return F.nullif(F.lower(F.substring(F.regexp_replace(col, r"^\s+", ""), 1, 1)), F.lit(""))


def blank_to_null(col: Column) -> Column:
    """The text without outer blanks; null, empty and blank are all null."""
    return F.nullif(F.regexp_replace(col, r"^\s+|\s+$", ""), F.lit(""))


def saturated_depth(col: Column) -> Column:
    """Depth as the second operand of a combination sees it: at most 254."""
    return F.least(col, F.lit(254))
