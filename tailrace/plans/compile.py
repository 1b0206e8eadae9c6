"""Compiles a query to one DataFrame.

Order is explicit: a :class:`Frame` carries the keys its rows are ordered by,
as a DataFrame has no order of its own.  A source is ordered by ``_time`` and
``_id``, a sort puts its keys before those, an aggregation is ordered by its
group.  ``head``, ``tail``, ``dedup``, ``first``, ``last`` and ``list`` go by
these keys, so they are deterministic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.numbers import fixed, is_numeric, number, prefix_number
from tailrace.functions.scalar import relative_time
from tailrace.lang import ast
from tailrace.lang.errors import QuerySemanticError
from tailrace.lang.parser import parse
from tailrace.plans.catalog import Catalog
from tailrace.plans.expr import Scope, filter_of, value_of
from tailrace.plans.semantic import check

#: Spans to choose from where timechart names none; at most MAX_BUCKETS buckets.
SPANS = ("1 second", "10 seconds", "1 minute", "5 minutes", "30 minutes", "1 hour", "1 day", "7 days", "30 days")
MAX_BUCKETS = 100
_UNITS = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}
_SECONDS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


@dataclass(frozen=True)
class Key:
    """An ordering key: a column, and how it is compared."""

    name: str
    descending: bool = False
    lexical: bool = False


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[Key, ...] = ()
    events: bool = True  # rows are still events: unknown fields are looked for in them
    hidden: tuple[str, ...] = field(default=())


def interval_of(span: str) -> str:
    """``5m`` and the like as an interval."""
    m = re.fullmatch(r"(\d+)\s*([a-z]+)", span.strip().lower())
    if not m or int(m.group(1)) == 0:
        raise QuerySemanticError(f"{span!r} is no span of time")
    unit = m.group(2)
    long = {"sec": "second", "min": "minute", "hr": "hour", "day": "day", "week": "week", "second": "second", "minute": "minute", "hour": "hour"}
    name = _UNITS.get(unit) or long.get(unit.rstrip("s"))
    if not name:
        raise QuerySemanticError(f"{span!r} is no span of time")
    return f"{m.group(1)} {name}s"


def _seconds(interval: str) -> float:
    n, unit = interval.split()
    return int(n) * _SECONDS[unit.rstrip("s")]


def time_bound(text: str, now: datetime | None = None) -> Column:
    """A bound such as ``-1h``, ``-1d@d``, ``now``, seconds since 1970 or an ISO time."""
    text = text.strip()
    base = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    if text == "now" or re.fullmatch(r"[+-]\d+[smhdw](@[smhdw])?|@[smhdw]", text):
        return relative_time(base, text)
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return F.timestamp_micros(F.lit(int(float(text) * 1_000_000)))
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise QuerySemanticError(f"{text!r} is no time") from None
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def _falling(c: Column, kind: str) -> Column:
    """A value that falls where ``c`` rises."""
    if is_numeric(kind):
        return -c
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return -F.unix_micros(c.cast("timestamp"))
    if kind == "boolean":
        return ~c
    # the complement of each byte, with an end that sorts a text after its extensions
    return F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


class Compiler:
    """``mode``: 'typed', or 'compat' for comparison and order of texts, numbers
    with six decimals, missing fields as empty texts and ``count(f)`` over rows."""

    def __init__(self, catalog: Catalog, mode: str = "typed", now: datetime | None = None):
        if mode not in ("typed", "compat"):
            raise ValueError(f"no mode {mode!r}")
        self.catalog, self.compat, self.now = catalog, mode == "compat", now
        self.steps = {
            ast.Where: self._where, ast.Stats: self._stats, ast.Timechart: self._timechart, ast.Table: self._table, ast.Fields: self._fields, ast.Sort: self._sort,
            ast.Head: self._head, ast.Tail: self._tail, ast.Eval: self._eval, ast.Dedup: self._dedup, ast.Rename: self._rename, ast.Rex: self._rex, ast.Search: self._filter,
        }

    def compile(self, query: str | ast.Query, earliest: str | None = None, latest: str | None = None) -> DataFrame:
        return visible(self.frame(query, earliest, latest))

    def frame(self, query: str | ast.Query, earliest: str | None = None, latest: str | None = None) -> Frame:
        tree = parse(query) if isinstance(query, str) else query
        check(tree)
        f = self._source(tree.commands[0], earliest, latest)
        for c in tree.commands[1:]:
            f = self.steps[type(c)](f, c)
        return f

    # --- helpers ---------------------------------------------------------------

    def _scope(self, f: Frame) -> Scope:
        return Scope(f.df, self.compat, f.events)

    def _order(self, f: Frame, reverse: bool = False) -> list[Column]:
        out = []
        for k in f.order:
            if k.name not in f.df.columns:
                continue
            down = k.descending != reverse
            kind = dict(f.df.dtypes)[k.name]
            c = F.col(f"`{k.name}`")
            keys = [F.coalesce(c.cast("string"), F.lit(""))] if k.lexical else [c]
            if not k.lexical and kind == "string" and not k.name.startswith("_"):
                # numbers by value and before other texts
                keys = [number(c, kind), c]
            for x in keys:
                # missing values come last in either direction, first in reverse
                out.append((x.desc_nulls_first() if reverse else x.desc_nulls_last()) if down else (x.asc_nulls_first() if reverse else x.asc_nulls_last()))
        return out

    # --- sources and filters -----------------------------------------------------

    def _source(self, c: ast.Search, earliest: str | None, latest: str | None) -> Frame:
        df = self.catalog.load(c.indexes)
        by_day = dict(df.dtypes).get("date") == "date"  # stored events lie in folders by day
        for bound in (earliest, c.earliest):
            if bound:
                at = time_bound(bound, self.now)
                df = df.filter(F.col("_time") >= at)
                df = df.filter(F.col("date") >= F.to_date(at)) if by_day else df
        for bound in (latest, c.latest):
            if bound:
                at = time_bound(bound, self.now)
                df = df.filter(F.col("_time") <= at)
                df = df.filter(F.col("date") <= F.to_date(at)) if by_day else df
        f = Frame(df, (Key("_time"), Key("_id")))
        if c.condition is not None:
            f = replace(f, df=f.df.filter(filter_of(c.condition, self._scope(f))))
        return f

    def _filter(self, f: Frame, c: ast.Search) -> Frame:
        df = f.df
        if c.indexes:
            if "index" not in df.columns:
                raise QuerySemanticError("the rows have no index any more")
            df = df.filter(reduce(lambda a, b: a | b, [F.col("index").like(p.replace("*", "%")) for p in c.indexes]))
        if c.earliest:
            df = df.filter(F.col("_time") >= time_bound(c.earliest, self.now))
        if c.latest:
            df = df.filter(F.col("_time") <= time_bound(c.latest, self.now))
        if c.condition is not None:
            df = df.filter(filter_of(c.condition, self._scope(f)))
        return replace(f, df=df)

    def _where(self, f: Frame, c: ast.Where) -> Frame:
        return replace(f, df=f.df.filter(filter_of(c.condition, self._scope(f))))

    # --- columns -------------------------------------------------------------------

    def _pick(self, f: Frame, names: tuple[str, ...]) -> Frame:
        scope = self._scope(f)
        names = tuple(dict.fromkeys(names))
        df = f.df.select(*[scope.field(n).column.alias(n) for n in names], *[F.col(f"`{k.name}`") for k in f.order if k.name in f.df.columns and k.name not in names])
        return replace(f, df=df, hidden=tuple(k.name for k in f.order if k.name in f.df.columns and k.name not in names))

    def _table(self, f: Frame, c: ast.Table) -> Frame:
        return replace(self._pick(f, c.fields), events=False)

    def _fields(self, f: Frame, c: ast.Fields) -> Frame:
        if c.exclude:
            return replace(f, df=f.df.drop(*c.fields))
        return replace(self._pick(f, c.fields), events=False)

    def _rename(self, f: Frame, c: ast.Rename) -> Frame:
        mapping = dict(c.pairs)
        scope = self._scope(f)
        df = f.df
        for old in mapping:
            if old not in df.columns:
                df = df.withColumn(old, scope.field(old).column)
        clash = [n for n in mapping.values() if n in df.columns and n not in mapping]
        df = df.drop(*clash).withColumnsRenamed(mapping)
        return replace(f, df=df, order=tuple(replace(k, name=mapping.get(k.name, k.name)) for k in f.order))

    def _eval(self, f: Frame, c: ast.Eval) -> Frame:
        for name, e in c.assignments:
            v = value_of(e, self._scope(f))
            f = replace(f, df=f.df.withColumn(name, v.column.cast("string") if v.dtype == "void" else v.column))
        return f

    def _rex(self, f: Frame, c: ast.Rex) -> Frame:
        names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", c.pattern)
        if not names:
            raise QuerySemanticError("a rex pattern needs a named group (?<name>...)")
        plain, positions, n = [], {}, 0
        k, escaped, bracket = 0, False, False
        while k < len(c.pattern):
            ch = c.pattern[k]
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", c.pattern[k:])
            if ch == "(" and not escaped and not bracket:
                if m:
                    n += 1
                    positions[m.group(1)] = n
                    plain.append("(")
                    k += m.end()
                    continue
                if c.pattern[k + 1 : k + 2] != "?":
                    n += 1
            if not escaped and ch in "[]":
                bracket = ch == "["
            escaped = ch == "\\" and not escaped
            plain.append(ch)
            k += 1
        source = self._scope(f).field(c.field).column.cast("string")
        pattern = "".join(plain)
        return replace(f, df=f.df.withColumns({name: F.nullif(F.regexp_extract(source, pattern, at), F.lit("")) for name, at in positions.items()}))

    # --- order -----------------------------------------------------------------------

    def _sort(self, f: Frame, c: ast.Sort) -> Frame:
        scope = self._scope(f)
        df = f.df
        for k in c.keys:
            if k.field not in df.columns:
                df = df.withColumn(k.field, scope.field(k.field).column)
        keys = tuple(Key(k.field, k.descending, self.compat) for k in c.keys)
        f = replace(f, df=df, order=keys + tuple(k for k in f.order if k.name not in {x.name for x in keys}))
        df = f.df.orderBy(*self._order(f))
        return replace(f, df=df.limit(c.limit) if c.limit else df)

    def _head(self, f: Frame, c: ast.Head) -> Frame:
        order = self._order(f)
        return replace(f, df=(f.df.orderBy(*order) if order else f.df).limit(c.n))

    def _tail(self, f: Frame, c: ast.Tail) -> Frame:
        order = self._order(f)
        if not order:
            return replace(f, df=f.df.limit(c.n))
        return replace(f, df=f.df.orderBy(*self._order(f, reverse=True)).limit(c.n).orderBy(*order))

    def _dedup(self, f: Frame, c: ast.Dedup) -> Frame:
        """The first ``n`` rows of each combination; rows that lack a field are left out."""
        scope = self._scope(f)
        keys = [scope.field(n).column for n in c.fields]
        df = f.df.filter(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))
        order = self._order(f) or [F.monotonically_increasing_id()]
        w = Window.partitionBy(*keys).orderBy(*order)
        return replace(f, df=df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= c.n).drop("__rank"))

    # --- aggregation --------------------------------------------------------------------

    def _aggregate(self, f: Frame, a: ast.Aggregate, scope: Scope) -> Column:
        if a.func == "count":
            if a.arg is None or self.compat:
                return F.count(F.lit(1))
            return F.count(value_of(a.arg, scope).column)
        v = value_of(a.arg, scope)
        c, kind = v.column, v.dtype
        n = prefix_number(c, kind) if self.compat else number(c, kind)
        text = c.cast("string")
        if a.func == "sum":
            if kind.startswith("decimal"):
                out = F.sum(c).cast("double")
            elif kind in ("tinyint", "smallint", "int", "bigint") and not self.compat:
                return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
            else:
                out = F.sum(n)
            out = F.coalesce(out, F.lit(0.0))
            return fixed(out) if self.compat else out
        if a.func == "avg":
            if kind.startswith("decimal"):
                out = F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
            else:
                out = F.avg(n)
            return F.coalesce(fixed(out), F.lit("0")) if self.compat else out
        if a.func in ("min", "max"):
            pick = F.min if a.func == "min" else F.max
            if self.compat:
                return fixed(pick(n))
            if is_numeric(kind):
                return pick(c).cast("double") if kind.startswith("decimal") else pick(c)
            if kind == "string":
                # numbers if there are any, else texts
                return F.coalesce(pick(n).cast("string"), pick(c))
            return pick(c)
        if a.func == "dc":
            return F.count_distinct(F.coalesce(text, F.lit("")) if self.compat else c)
        if a.func == "values":
            return F.concat_ws(", ", F.array_sort(F.collect_set(text)))
        at = self._place(f)
        if a.func == "list":
            pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), text.alias("x"))))
            return F.transform(F.filter(pairs, lambda p: p["x"].isNotNull()), lambda p: p["x"])
        value = F.coalesce(text, F.lit("")) if self.compat else c
        return (F.min_by if a.func == "first" else F.max_by)(value, at)

    def _place(self, f: Frame) -> Column:
        """A row's place in the order, as a value that rises along it."""
        parts, kinds = [], dict(f.df.dtypes)
        for k in f.order:
            if k.name not in kinds:
                continue
            c, kind = F.col(f"`{k.name}`"), kinds[k.name]
            if k.lexical:
                keys = [(F.coalesce(c.cast("string"), F.lit("")), "string")]
            elif kind == "string" and not k.name.startswith("_"):
                keys = [(number(c, kind), "double"), (c, "string")]
            else:
                keys = [(c, kind)]
            for x, t in keys:
                parts += [x.isNull(), _falling(x, t) if k.descending else x]
        if not parts:
            return F.monotonically_increasing_id()
        return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])

    def _stats(self, f: Frame, c: ast.Stats) -> Frame:
        """Groups by the given fields; without rows there is no group, so no row."""
        scope = self._scope(f)
        keys = []
        for n in dict.fromkeys(c.by):
            k = scope.field(n).column
            keys.append((F.coalesce(k.cast("string"), F.lit("")) if self.compat else k).alias(n))
        aggregates = [self._aggregate(f, a, scope).alias(a.name) for a in c.aggregates]
        if keys:
            df = f.df.groupBy(*keys).agg(*aggregates)
        else:
            df = f.df.groupBy(F.lit(1).alias("__all")).agg(*aggregates).drop("__all")
        return Frame(df, tuple(Key(n, lexical=self.compat) for n in dict.fromkeys(c.by)), events=False)

    def _span(self, f: Frame) -> str:
        """The least span that cuts the range of the rows into MAX_BUCKETS buckets or fewer."""
        r = f.df.agg(F.min("_time").cast("timestamp").alias("a"), F.max("_time").cast("timestamp").alias("b")).first()
        length = (r.b - r.a).total_seconds() if r and r.a else 0
        return next((s for s in SPANS if length / _seconds(s) <= MAX_BUCKETS), SPANS[-1])

    def _timechart(self, f: Frame, c: ast.Timechart) -> Frame:
        """Long form: one row for each bucket (and value of the split field) with events."""
        if "_time" not in f.df.columns:
            raise QuerySemanticError("timechart needs _time")
        interval = interval_of(c.span) if c.span else self._span(f)
        scope = self._scope(f)
        # all buckets are counted from 1970-01-01
        bucket = F.window("_time", interval).getField("start").alias("_time")
        keys = [bucket] + ([scope.field(c.by).column.alias(c.by)] if c.by else [])
        df = f.df.filter(F.col("_time").isNotNull()).groupBy(*keys).agg(*[self._aggregate(f, a, scope).alias(a.name) for a in c.aggregates])
        return Frame(df, (Key("_time"),) + ((Key(c.by),) if c.by else ()), events=False)


def visible(f: Frame) -> DataFrame:
    """The columns to show: ordering keys that a projection only carried along are left out."""
    return f.df.drop(*[n for n in f.hidden if n in f.df.columns])


def wide(chart: DataFrame, split: str, value: str, values: list[str], other: str = "OTHER") -> DataFrame:
    """A split timechart with one column for each of ``values``, and one for the rest."""
    named = chart.withColumn("__s", F.when(F.col(split).isin(values), F.col(split)).otherwise(F.lit(other)))
    return named.groupBy("_time").pivot("__s", [*values, other]).agg(F.sum(value))


def filled(chart: DataFrame, span: str, value: str, empty: float = 0) -> DataFrame:
    """A timechart without split, with a row for every bucket between the first and
    the last; buckets without events get ``empty``."""
    ends = chart.agg(F.min("_time").alias("a"), F.max("_time").alias("b")).filter("a is not null")
    all_buckets = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {interval_of(span)}"))).alias("_time"))
    return all_buckets.join(chart, "_time", "left").withColumn(value, F.coalesce(value, F.lit(empty)))
