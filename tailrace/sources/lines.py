"""Breaking data into events, and telling sourcetypes from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("single", "multi", "json", "auto")
# A line that doesn't begin with a blank starts an event; a blank goes on with it.
_MULTI = r"\r?\n(?![ \t])"


def break_lines(data: DataFrame, mode: str = "auto", column: str = "value", pattern: str | None = None) -> DataFrame:
    """One row for each event in ``column``, as ``raw`` with its place ``event_no``.

    single: every line; multi: lines with the indented ones after them; json:
    the elements of an array, or of one object; auto: json if the data begins
    with ``[`` or ``{``, multi if any line is indented, else single.  ``pattern``
    splits at matches of one's own.  Empty events are left out.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    c = F.col(column)
    single = F.split(c, r"\r?\n")
    multi = F.split(c, _MULTI)
    trimmed = F.trim(c)
    as_json = F.transform(F.from_json(F.when(trimmed.startswith("["), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]"))), "array<variant>"), lambda v: F.to_json(v))
    if pattern is not None:
        pieces = F.split(c, pattern)
    elif mode == "auto":
        looks_json = trimmed.rlike(r"(?s)^\[\s*[\[{].*\]$")
        pieces = F.when(looks_json, F.coalesce(as_json, single)).when(c.rlike(r"\n[ \t]+\S"), multi).otherwise(single)
    else:
        pieces = {"single": single, "multi": multi, "json": as_json}[mode]
    out = data.select("*", F.posexplode(pieces).alias("event_no", "raw"))
    return out.filter(F.trim("raw") != "")


def sourcetype_of(path: Column) -> Column:
    """The sourcetype a file name suggests."""
    name = F.lower(F.substring_index(path, "/", -1))
    # Patterns of file names and their sourcetypes.
    return (
        F.when(name.rlike(r"auth\.log|^secure"), "linux_secure")
        .when(name.rlike(r"syslog|^messages"), "syslog")
        .when(name.rlike(r"access.*log|access_log"), "access_combined")
        .when(name.rlike(r"error.*log|error_log"), "error_log")
        .when(name.endswith(".json"), "json")
        .when(name.endswith(".csv"), "csv")
        .otherwise("generic_single_line")
    )
