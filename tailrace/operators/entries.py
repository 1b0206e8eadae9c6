"""Log lines into entries with timestamp, level, component and message (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.loglines import parse_line
from tailrace.io import host_key, saved, small

#: Rows of one batch, host and source are ordered in blocks of so many positions.
BLOCK = 100_000

_PARSE = "begins boolean, time_text string, lvl string, component string, message string, unparsed string, score double"
_GROUP = ["b", "h", "s", "solo", "deep"]


def _parsed(df: DataFrame, raw: str) -> DataFrame:
    """Adds the parse of column ``raw``; the lines are parsed in Arrow batches,
    with the parser's state shared by all batches of a worker."""
    names = [x.split()[0] for x in _PARSE.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != raw) + ", " + _PARSE
    types = [pa.bool_(), *[pa.string()] * 5, pa.float64()]
    nothing = (False, None, None, None, None, None, None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(raw)
            rows = [nothing if p is None else (p.time is not None, *p) for p in map(parse_line, b.column(at).to_pylist())]
            out = list(zip(*rows)) if rows else [[] for _ in names]
            kept = [(f.name, c) for f, c in zip(b.schema, b.columns) if f.name != raw]
            arrays = [c for _, c in kept] + [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in kept] + names)

    return df.mapInArrow(parse, schema)


def parse_lines(rows: DataFrame, raw: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the parse of each row's text: begins, time_text, lvl,
    component, message, unparsed (what the best parse leaves out) and score.
    Null and blank text begins nothing and has null fields."""
    return _parsed(rows.select(*(keep or []), raw), raw)


def _segments(wire: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Runs of rows of one entry within a block: (batch, host, source, solo, block, entry,
    first/last position and delivery, lvl, component, bare).  ``entry`` is null for
    rows that go on with an entry of an earlier block, or with none.  Rows without a
    batch or a place in it are ``solo``, each a group of its own.  ``deep``: the
    batch has several blocks; there is at most one such batch for BLOCK places.

    With ``keep`` also these columns, time_text, message and unparsed of the first row, and
    ``texts`` (pos, delivery_id, text) of the rows that begin nothing."""
    full = keep is not None
    keep = keep or []
    placed = F.col("batch_id").isNotNull() & F.col("batch_pos").isNotNull()
    several = small(wire.filter(F.col("batch_pos") >= BLOCK).select(F.col("batch_id").alias("__deep")).distinct())
    lines = wire.join(several, F.col("batch_id") == F.col("__deep"), "left").filter(F.trim(F.regexp_replace("raw", r"\s+", " ")) != "").select(
        "delivery_id",
        F.when(placed, F.col("batch_id")).otherwise(-1).alias("b"),
        F.when(placed, F.col("batch_pos")).otherwise(0).alias("pos"),
        F.coalesce(F.concat(F.lit("="), host_key(F.col("host"))), F.lit("")).alias("h"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("s"),
        F.when(~placed, F.col("delivery_id")).otherwise(-1).alias("solo"),
        (placed & F.col("__deep").isNotNull()).alias("deep"),
        F.col("fields").isNull().alias("bare"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
        "raw",
    )
    # text that is blank in a wider sense has no level, not even an empty one
    rows = _parsed(lines, "raw").filter("lvl is not null").withColumn("block", F.call_function("div", F.col("pos"), F.lit(BLOCK))).drop("score")
    if not full:  # what isn't asked for is parsed, but doesn't travel
        rows = rows.drop("time_text", "message", "unparsed")
    w = Window.partitionBy(*_GROUP, "block").orderBy("pos", "delivery_id").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("entry", F.last(F.when(F.col("begins"), F.col("delivery_id")), ignorenulls=True).over(w))
    at = F.struct("pos", "delivery_id")
    own = lambda c: F.max(F.when(F.col("begins"), F.col(c)))
    more = []
    if full:
        text = F.when(~F.col("begins"), F.struct("pos", "delivery_id", F.col("unparsed").alias("text")))
        more = [own("time_text").alias("time_text"), own("message").alias("message"), own("unparsed").alias("unparsed"), *[own(f"keep_{c}").alias(c) for c in keep], F.collect_list(text).alias("texts")]
    return run.groupBy(*_GROUP, "block", "entry").agg(
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        own("lvl").alias("lvl"),
        own("component").alias("component"),
        own("bare").alias("bare"),
        *more,
    )


def _opened(segments: DataFrame) -> DataFrame:
    """(group, block, open): the entry that is open where each block begins.

    The window runs over one row a block, not over rows or segments."""
    begun = F.when(F.col("entry").isNotNull(), F.struct("first", "entry"))
    blocks = segments.groupBy(*_GROUP, "block").agg(F.max(begun).getField("entry").alias("top"))
    before = Window.partitionBy(*_GROUP).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*_GROUP, "block", F.last("top", ignorenulls=True).over(before).alias("open")).filter("open is not null")


def assemble(wire: DataFrame) -> DataFrame:
    """Entries: (first_delivery_id, last_delivery_id, lvl, component, bare).

    A row that states a time begins an entry; a non-blank row without one goes
    on with the latest entry above it in its batch with the same host and
    source (null equals null), or belongs to none; so does one without a batch
    or a place in it.  ``bare``: the first row has null ``fields``.  Rows of one
    batch, host and source are ordered in blocks; what a block begins with is
    attached to the last entry of the blocks before it, so no task holds such a
    group as a whole.
    """
    segments = saved(_segments(wire), "segments")
    begun, deep = segments.filter("entry is not null"), segments.filter("deep")
    whole = lambda df, last: df.select(F.col("entry").alias("first_delivery_id"), last.getField("delivery_id").alias("last_delivery_id"), "lvl", "component", "bare")
    # only blocks after the first can go on with an earlier one
    orphans = deep.filter("entry is null and block > 0").select(*_GROUP, "block", "last")
    carried = orphans.join(_opened(deep), [*_GROUP, "block"]).groupBy(F.col("open").alias("entry")).agg(F.max("last").alias("more"))
    longer = begun.filter("deep").join(carried, "entry", "left")
    return whole(begun.filter("not deep"), F.col("last")).unionByName(whole(longer, F.greatest(F.col("last"), F.coalesce("more", "last"))))


def records(wire: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Entries with all their text: (delivery_id, last_delivery_id, ``keep`` of the
    first row, time_text, lvl, component, message, unparsed), entries as in
    :func:`assemble`.

    ``message`` is that of the first row and below it, line by line, the text of
    the rows that go on with the entry; ``unparsed`` is what the first row's parse
    leaves out.  A row that belongs to no entry is put
    out by itself, with its text in ``unparsed`` and null in the other fields.
    """
    keep = keep or []
    segments = saved(_segments(wire, keep), "records")
    begun, deep = segments.filter("entry is not null"), segments.filter("deep")
    # what a block begins with goes on with the last entry of the nearest block before it
    opened = deep.filter("entry is null").select(*_GROUP, "block", "texts").join(_opened(deep), [*_GROUP, "block"], "left")
    loose = segments.filter("entry is null and not deep").select("texts", F.lit(None).cast("bigint").alias("open")).unionByName(opened.select("texts", "open"))
    carried = opened.filter("open is not null").groupBy(F.col("open").alias("entry")).agg(F.flatten(F.collect_list("texts")).alias("carried"))
    texts = F.array_sort(F.concat("texts", F.coalesce("carried", F.array().cast(loose.schema["texts"].dataType))))
    longer = begun.filter("deep").join(carried, "entry", "left").withColumn("texts", texts).drop("carried")
    whole = begun.filter("not deep").withColumn("texts", F.array_sort("texts")).unionByName(longer)
    several = F.size("texts") > 0
    entries = whole.select(
        F.col("entry").alias("delivery_id"),
        F.when(several, F.element_at("texts", -1).getField("delivery_id")).otherwise(F.col("entry")).alias("last_delivery_id"),
        *keep, "time_text", "lvl", "component",
        F.when(several, F.concat_ws("\n", "message", F.col("texts.text"))).otherwise(F.col("message")).alias("message"),
        "unparsed",
    )
    alone = loose.filter("open is null").select(F.explode("texts").alias("t")).select(F.col("t.delivery_id").alias("delivery_id"), F.col("t.delivery_id").alias("last_delivery_id"), F.col("t.text").alias("unparsed"))
    return entries.unionByName(alone, allowMissingColumns=True)


def found(wire: DataFrame) -> DataFrame:
    """Entries whose first row has null ``fields``, with the level and writer read from the text."""
    return assemble(wire).filter("bare").drop("bare")
