"""Scalar functions of the query language: name -> builder of a column.

A builder gets the arguments as :class:`Value` (column and type name) and
returns one.  ``register`` adds functions of one's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailrace.functions.numbers import is_numeric, number


class Value(NamedTuple):
    column: Column
    dtype: str
    literal: object = None
    is_literal: bool = False


def text(v: Value) -> Column:
    return v.column.cast("string")


def num(v: Value) -> Column:
    return number(v.column, v.dtype)


def truth(v: Value) -> Column:
    """Two-valued: what is unknown is false."""
    if v.dtype == "boolean":
        return F.coalesce(v.column, F.lit(False))
    return F.coalesce(num(v) != 0, F.lit(False))


def common_type(values: list[Value]) -> tuple[list[Column], str]:
    kinds = {v.dtype for v in values if v.dtype != "void"}
    if len(kinds) == 1:
        kind = kinds.pop()
        return [v.column.cast(kind) for v in values], kind
    if kinds and all(is_numeric(k) for k in kinds):
        return [v.column.cast("double") for v in values], "double"
    return [text(v) for v in values], "string"


# What a letter after % stands for in a time format.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d", "z": "xx"}
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def java_format(pattern: str) -> str:
    out = []
    for part in re.split(r"(%.)", pattern):
        if part.startswith("%") and len(part) == 2:
            out.append("'%'" if part == "%%" else STRFTIME[part[1]] if part[1] in STRFTIME else f"'{part[1]}'")
        elif part:
            out.append("'" + part.replace("'", "''") + "'")
    return "".join(out)


def as_time(v: Value) -> Column:
    """A time from a timestamp, or from seconds since 1970."""
    if v.dtype.startswith("timestamp") or v.dtype == "date":
        return v.column.cast("timestamp")
    return F.timestamp_micros((num(v) * 1_000_000).cast("bigint"))


def _need(values: list[Value], least: int, most: int | None, name: str) -> None:
    if len(values) < least or (most is not None and len(values) > most):
        raise ValueError(f"{name} takes {least if least == most else f'{least} to {most or "any number of"}'} arguments, not {len(values)}")


def _literal(v: Value, what: str) -> str:
    if not v.is_literal:
        raise ValueError(f"{what} must be written out")
    return str(v.literal)


def _case(v: list[Value]) -> Value:
    if len(v) % 2:
        raise ValueError("case takes pairs of a condition and a value")
    columns, kind = common_type(v[1::2])
    chain = None
    for c, x in zip(v[::2], columns):
        chain = F.when(truth(c), x) if chain is None else chain.when(truth(c), x)
    return Value(chain, kind)


def _if(v: list[Value]) -> Value:
    (a, b), kind = common_type(v[1:])
    return Value(F.when(truth(v[0]), a).otherwise(b), kind)


def _coalesce(v: list[Value]) -> Value:
    columns, kind = common_type(v)
    return Value(F.coalesce(*columns), kind)


def _round(v: list[Value]) -> Value:
    digits = int(_literal(v[1], "the number of digits")) if len(v) > 1 else 0
    scale = 10**digits
    return Value(F.floor(num(v[0]) * scale + 0.5).cast("double") / scale, "double")


def _extreme(pick: Callable) -> Callable[[list[Value]], Value]:
    def build(v: list[Value]) -> Value:
        columns, kind = common_type(v)
        return Value(pick(*columns) if len(columns) > 1 else columns[0], kind)

    return build


def _substr(v: list[Value]) -> Value:
    start = F.lit(int(_literal(v[1], "the start"))) if v[1].is_literal else num(v[1]).cast("int")
    length = num(v[2]).cast("int") if len(v) > 2 else F.length(text(v[0]))
    return Value(text(v[0]).substr(start, length), "string")


def _relative(v: list[Value]) -> Value:
    return Value(relative_time(as_time(v[0]), _literal(v[1], "the shift")), "timestamp")


def relative_time(at: Column, shift: str) -> Column:
    """``at`` moved by a shift such as ``-1h``, ``+2d`` or ``-1d@d`` (cut to the unit after @)."""
    m = re.fullmatch(r"([+-]?\d+)?([smhdw])?(?:@([smhdw]))?|now", shift.strip())
    if not m:
        raise ValueError(f"{shift!r} is no shift of a time")
    if m.group(2):
        us = int(m.group(1) or 1) * UNIT_SECONDS[m.group(2)] * 1_000_000
        at = F.timestamp_micros(F.unix_micros(at) + us)
    if m.group(3):
        at = F.date_trunc({"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}[m.group(3)], at)
    return at


def _strptime(v: list[Value]) -> Value:
    return Value(F.unix_micros(F.try_to_timestamp(text(v[0]), F.lit(java_format(_literal(v[1], "the format"))))) / 1_000_000, "double")


_BUILDERS: dict[str, tuple[int, int | None, Callable[[list[Value]], Value]]] = {
    "if": (3, 3, _if),
    "case": (2, None, _case),
    "coalesce": (1, None, _coalesce),
    "null": (0, 0, lambda v: Value(F.lit(None).cast("string"), "string")),
    "true": (0, 0, lambda v: Value(F.lit(True), "boolean")),
    "false": (0, 0, lambda v: Value(F.lit(False), "boolean")),
    "isnull": (1, 1, lambda v: Value(v[0].column.isNull(), "boolean")),
    "isnotnull": (1, 1, lambda v: Value(v[0].column.isNotNull(), "boolean")),
    "isnum": (1, 1, lambda v: Value(num(v[0]).isNotNull(), "boolean")),
    "nullif": (2, 2, lambda v: Value(F.when(~v[0].column.eqNullSafe(v[1].column), v[0].column), v[0].dtype)),
    "lower": (1, 1, lambda v: Value(F.lower(text(v[0])), "string")),
    "upper": (1, 1, lambda v: Value(F.upper(text(v[0])), "string")),
    "len": (1, 1, lambda v: Value(F.length(text(v[0])), "int")),
    "trim": (1, 1, lambda v: Value(F.trim(text(v[0])), "string")),
    "ltrim": (1, 1, lambda v: Value(F.ltrim(text(v[0])), "string")),
    "rtrim": (1, 1, lambda v: Value(F.rtrim(text(v[0])), "string")),
    "substr": (2, 3, _substr),
    "replace": (3, 3, lambda v: Value(F.regexp_replace(text(v[0]), text(v[1]), text(v[2])), "string")),
    "match": (2, 2, lambda v: Value(F.coalesce(F.rlike(text(v[0]), text(v[1])), F.lit(False)), "boolean")),
    "like": (2, 2, lambda v: Value(F.coalesce(F.like(text(v[0]), text(v[1])), F.lit(False)), "boolean")),
    "split": (2, 2, lambda v: Value(F.split(text(v[0]), "\\Q" + _literal(v[1], "the separator") + "\\E"), "array<string>")),
    "mvcount": (1, 1, lambda v: Value(F.when(F.size(v[0].column) > 0, F.size(v[0].column)) if v[0].dtype.startswith("array") else F.when(v[0].column.isNotNull(), 1), "int")),
    "mvindex": (2, 2, lambda v: Value(F.try_element_at(v[0].column, (num(v[1]).cast("int") + F.when(num(v[1]) >= 0, 1).otherwise(0))), "string")),
    "mvjoin": (2, 2, lambda v: Value(F.array_join(v[0].column, _literal(v[1], "the separator")), "string")),
    "tonumber": (1, 1, lambda v: Value(num(v[0]), "double")),
    "tostring": (1, 1, lambda v: Value(text(v[0]), "string")),
    "abs": (1, 1, lambda v: Value(F.abs(num(v[0])), "double")),
    "floor": (1, 1, lambda v: Value(F.floor(num(v[0])), "bigint")),
    "ceil": (1, 1, lambda v: Value(F.ceil(num(v[0])), "bigint")),
    "ceiling": (1, 1, lambda v: Value(F.ceil(num(v[0])), "bigint")),
    "round": (1, 2, _round),
    "sqrt": (1, 1, lambda v: Value(F.when(num(v[0]) >= 0, F.sqrt(num(v[0]))), "double")),
    "pow": (2, 2, lambda v: Value(F.pow(num(v[0]), num(v[1])), "double")),
    "exp": (1, 1, lambda v: Value(F.exp(num(v[0])), "double")),
    "ln": (1, 1, lambda v: Value(F.when(num(v[0]) > 0, F.ln(num(v[0]))), "double")),
    "min": (1, None, _extreme(F.least)),
    "max": (1, None, _extreme(F.greatest)),
    "md5": (1, 1, lambda v: Value(F.md5(text(v[0])), "string")),
    "sha256": (1, 1, lambda v: Value(F.sha2(text(v[0]), 256), "string")),
    "now": (0, 0, lambda v: Value(F.current_timestamp(), "timestamp")),
    "strftime": (2, 2, lambda v: Value(F.date_format(as_time(v[0]), java_format(_literal(v[1], "the format"))), "string")),
    "strptime": (2, 2, _strptime),
    "relative_time": (2, 2, _relative),
}


def register(name: str, builder: Callable[[list[Value]], Value], least: int = 0, most: int | None = None) -> None:
    """Makes ``name(...)`` available to queries."""
    _BUILDERS[name.lower()] = (least, most, builder)


def call(name: str, values: list[Value]) -> Value:
    if name not in _BUILDERS:
        raise ValueError(f"there is no function {name!r}")
    least, most, build = _BUILDERS[name]
    _need(values, least, most, name)
    return build(values)


def known(name: str) -> bool:
    return name in _BUILDERS
