"""Numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(dtype: str) -> bool:
    return dtype in _NUMERIC or dtype.startswith("decimal")


def number(value: Column, dtype: str) -> Column:
    """``value`` as a double; null for texts that are no plain number."""
    if is_numeric(dtype):
        return value.cast("double")
    if dtype == "boolean":
        return value.cast("double")
    text = value.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def prefix_number(value: Column, dtype: str) -> Column:
    """As :func:`number`, but a text counts as the number it begins with."""
    if is_numeric(dtype):
        return value.cast("double")
    return F.nullif(F.regexp_extract(value.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def fixed(value: Column) -> Column:
    """A number as text with six decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.6f", value.cast("double")))
