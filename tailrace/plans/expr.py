"""Expressions and search conditions of the query language as columns.

Predicates are two-valued: a comparison with something missing is false, and
NOT of it true.  A comparison is numeric if both sides are numbers, or texts
that both read as numbers; else it compares texts.  In compat mode all
comparisons are of texts, byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions import scalar
from tailrace.functions.numbers import is_numeric
from tailrace.functions.scalar import Value, num, text, truth
from tailrace.functions.text import extracted, has_phrase, has_token, wildcard_like
from tailrace.lang import ast
from tailrace.lang.errors import QuerySemanticError

_ARITHMETIC = "+-*/%"


@dataclass
class Scope:
    """What names mean: the columns at hand, and whether unknown ones are looked
    for in the event (its ``fields``, then its raw text)."""

    df: DataFrame
    compat: bool = False
    extract: bool = True

    def __post_init__(self):
        self.types = dict(self.df.dtypes)

    def field(self, name: str) -> Value:
        if name in self.types:
            return Value(F.col(f"`{name}`"), self.types[name])
        found = []
        if self.extract and self.types.get("fields") == "map<string,string>":
            found.append(F.try_element_at(F.col("fields"), F.lit(name)))
        if self.extract and self.types.get("_raw") == "string":
            found.append(extracted(F.col("_raw"), name))
        return Value(F.coalesce(*found) if found else F.lit(None).cast("string"), "string")


def value_of(e: object, scope: Scope) -> Value:
    if isinstance(e, ast.Literal):
        kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(e.value), "void")
        return Value(F.lit(e.value), kind, e.value, True)
    if isinstance(e, ast.Field):
        return scope.field(e.name)
    if isinstance(e, ast.Call):
        try:
            return scalar.call(e.name, [value_of(a, scope) for a in e.args])
        except ValueError as x:
            raise QuerySemanticError(str(x)) from None
    if isinstance(e, ast.Binary) and e.op in _ARITHMETIC:
        return _arithmetic(e.op, value_of(e.left, scope), value_of(e.right, scope))
    if isinstance(e, ast.Binary) and e.op == ".":
        return Value(F.concat(text(value_of(e.left, scope)), text(value_of(e.right, scope))), "string")
    return Value(condition_of(e, scope), "boolean")


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and "string" in (a.dtype, b.dtype):
        # texts that aren't both numbers are put together
        x, y = num(a), num(b)
        return Value(F.when(x.isNotNull() & y.isNotNull(), (x + y).cast("string")).otherwise(F.concat(text(a), text(b))), "string")
    whole = {"tinyint", "smallint", "int", "bigint"}
    if a.dtype in whole and b.dtype in whole and op in "+-*":
        x, y = a.column.cast("bigint"), b.column.cast("bigint")
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Value(made, "bigint")
    x, y = num(a), num(b)
    if op == "/":
        return Value(F.try_divide(x, y), "double")
    if op == "%":
        return Value(F.when(y != 0, x % y), "double")
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], "double")


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compare(op: str, a: Value, b: Value, compat: bool = False, two_valued: bool = True) -> Column:
    """A comparison.  ``two_valued``: false where a side is missing; else null there,
    which serves a filter as well and leaves a form that can reach the scan."""

    def done(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)) if two_valued else c

    if compat:
        return done(_ordered(op, text(a), text(b)))
    a, b = _literal_as(a, b), _literal_as(b, a)
    if is_numeric(a.dtype) and is_numeric(b.dtype) or a.dtype == b.dtype == "boolean":
        return done(_ordered(op, a.column, b.column))
    times = ("timestamp", "timestamp_ntz", "date")
    if a.dtype in times or b.dtype in times:
        sides = []
        for v in (a, b):
            sides.append(v.column.cast("timestamp") if v.dtype in times else F.try_to_timestamp(text(v)) if v.dtype == "string" else scalar.as_time(v))
        return done(_ordered(op, *sides))
    if a.dtype == b.dtype == "string" and any(v.is_literal and not _reads_as_number(v.literal) for v in (a, b)):
        return done(_ordered(op, a.column, b.column))
    x, y = num(a), num(b)
    both = x.isNotNull() & y.isNotNull()
    return done(F.when(both, _ordered(op, x, y)).otherwise(_ordered(op, text(a), text(b))))


def _literal_as(v: Value, other: Value) -> Value:
    """A quoted number beside a numeric column as a number."""
    if v.is_literal and v.dtype == "string" and is_numeric(other.dtype) and _reads_as_number(v.literal):
        n = float(str(v.literal))
        whole = n.is_integer() and abs(n) < 2**53
        return Value(F.lit(int(n)) if whole else F.lit(n), "bigint" if whole else "double", n, True)
    return v


def _reads_as_number(s: object) -> bool:
    try:
        float(str(s))
    except ValueError:
        return False
    return True


def condition_of(e: object, scope: Scope, two_valued: bool = True) -> Column:
    """A predicate.  Without ``two_valued`` it may be null instead of false, as
    filters take it; below a NOT it is always two-valued."""

    def done(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)) if two_valued else c

    if isinstance(e, ast.And):
        return condition_of(e.left, scope, two_valued) & condition_of(e.right, scope, two_valued)
    if isinstance(e, ast.Or):
        return condition_of(e.left, scope, two_valued) | condition_of(e.right, scope, two_valued)
    if isinstance(e, ast.Not):
        return ~condition_of(e.operand, scope, True)
    if isinstance(e, ast.Binary) and e.op not in _ARITHMETIC and e.op != ".":
        return compare(e.op, value_of(e.left, scope), value_of(e.right, scope), scope.compat, two_valued)
    if isinstance(e, ast.In):
        v = value_of(e.operand, scope)
        options = [value_of(x, scope) for x in e.values]
        plain = v.dtype == "string" and all(o.is_literal and o.dtype == "string" and not _reads_as_number(o.literal) for o in options)
        if plain or is_numeric(v.dtype) and all(o.is_literal and is_numeric(o.dtype) for o in options):
            return done(v.column.isin([o.literal for o in options]))
        return reduce(lambda x, y: x | y, [compare("=", v, o, scope.compat, two_valued) for o in options])
    if isinstance(e, ast.Like):
        return done(F.like(text(value_of(e.operand, scope)), text(value_of(e.pattern, scope))))
    if isinstance(e, ast.Term):
        return has_token(text(scope.field("_raw")), e.text, F.col("__lowered") if "__lowered" in scope.types else None)
    if isinstance(e, ast.Phrase):
        return has_phrase(text(scope.field("_raw")), e.text, F.col("__lowered") if "__lowered" in scope.types else None)
    if isinstance(e, ast.Match):
        v = scope.field(e.field)
        if e.op in ("=", "!=") and "*" in str(e.value):
            hit = v.column.isNotNull() if str(e.value) == "*" else F.coalesce(F.like(text(v), F.lit(wildcard_like(str(e.value)))), F.lit(False))
            return hit if e.op == "=" else ~hit & v.column.isNotNull()
        return compare(e.op, v, Value(F.lit(str(e.value)), "string", str(e.value), True), scope.compat, two_valued)
    return truth(value_of(e, scope))


def filter_of(e: object, scope: Scope) -> Column:
    """A predicate for a filter."""
    return condition_of(e, scope, two_valued=False)
