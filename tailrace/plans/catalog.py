"""Indexes: named tables seen through the event model."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event model: name -> type.  A table may have more columns.
EVENT = {
    "_time": "timestamp",
    "_id": "bigint",
    "index": "string",
    "host": "string",
    "source": "string",
    "sourcetype": "string",
    "_raw": "string",
    "fields": "map<string,string>",
}


class Catalog:
    """name -> loader of a DataFrame in the event model."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._loaders: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], **columns: Column | str | None) -> None:
        """Makes a table searchable as index ``name``.

        ``columns`` gives the event columns by name (time, id, host, source,
        sourcetype, raw, fields) as an expression or a column name; those not
        given are taken from a column of that name, else null.
        """
        self._loaders[name] = lambda: adapt(df() if callable(df) else df, name, **columns)

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def select(self, patterns: tuple[str, ...]) -> list[str]:
        """Names that match any of the patterns (``*`` for any text); none given: all."""
        wanted = patterns or ("*",)
        return [n for n in self.names() if any(fnmatchcase(n, p) for p in wanted)]

    def load(self, patterns: tuple[str, ...]) -> DataFrame:
        """The union of the matching indexes; an empty table if none matches."""
        parts = [self._loaders[n]() for n in self.select(patterns)]
        if not parts:
            return self.empty()
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _same_types(parts))

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in EVENT.items()))


def adapt(df: DataFrame, index: str, **columns: Column | str | None) -> DataFrame:
    """``df`` with the event columns first, its own other columns after them."""
    given = {("_" + k if k in ("time", "id", "raw") else k): v for k, v in columns.items()}
    unknown = set(given) - set(EVENT)
    if unknown:
        raise ValueError(f"no event columns: {sorted(unknown)}")
    out = []
    for name, kind in EVENT.items():
        c = given.get(name)
        if name == "index":
            c = F.lit(index) if c is None else c
        if c is None and name in df.columns:
            c = name
        if c is None:
            out.append(F.lit(None).cast(kind).alias(name))
        else:
            out.append((F.col(f"`{c}`") if isinstance(c, str) else c).cast(kind).alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in EVENT])


def _same_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns that differ in type between the tables become text."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for n, t in p.dtypes:
            kinds.setdefault(n, set()).add(t)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    return [p.withColumns({n: F.col(f"`{n}`").cast("string") for n in p.columns if n in mixed}) if mixed else p for p in parts]
