"""Raw events into the event model: defaults, times and ids."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.functions.instants import micros_of_number
from tailrace.functions.syslog import event_time, syslog_fields
from tailrace.functions.text import extract_map

#: What an ingest batch may say about all its events, with the defaults.
DEFAULTS = {"index": "main", "host": "unknown", "source": "http", "sourcetype": "json"}
INPUT = "raw string, host string, source string, sourcetype string, index string, timestamp_us bigint"


def batch(spark: SparkSession, events: Iterable[dict], **defaults: str) -> DataFrame:
    """A batch as posted: each event may override what holds for the batch; one
    without ``raw`` is kept as its JSON text."""
    base = DEFAULTS | {k: v for k, v in defaults.items() if v is not None}
    rows = []
    for e in events:
        raw = e.get("raw")
        rows.append((json.dumps(e, sort_keys=True) if raw is None else str(raw), *(str(e.get(k) or base[k]) for k in ("host", "source", "sourcetype", "index")), int(e.get("timestamp_us") or 0)))
    if not rows:
        raise ValueError("a batch needs at least one event")
    return spark.createDataFrame(rows, INPUT)


def normalise(rows: DataFrame, received: Column | None = None, with_fields: bool = False) -> DataFrame:
    """``rows`` (columns of INPUT) in the event model.

    The time is ``timestamp_us`` in whatever unit, else the one written in
    ``raw``, else that of receipt.  Ids are hashes of content and time, the same
    in every run.  Null texts make events with a null ``_raw``.
    """
    now = F.current_timestamp() if received is None else received
    given = F.timestamp_micros(micros_of_number(F.when(F.col("timestamp_us") != 0, F.col("timestamp_us"))))
    time = F.coalesce(given, event_time(F.col("raw"), now), now)
    timed = rows.withColumn("_time", time)
    names = {k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)).alias(k) for k, v in DEFAULTS.items()}
    return timed.select(
        "_time",
        F.xxhash64("_time", "index", "host", "source", "sourcetype", "raw").alias("_id"),
        names["index"], names["host"], names["source"], names["sourcetype"],
        F.col("raw").alias("_raw"),
        (extract_map(F.col("raw")) if with_fields else F.lit(None).cast("map<string,string>")).alias("fields"),
        F.to_date("_time").alias("date"),
    )


def from_syslog(lines: DataFrame, line: str = "value", sender: str | None = None, index: str = "main") -> DataFrame:
    """Syslog datagrams as input rows: trailing line ends are cut, empty ones left out."""
    text = F.regexp_replace(F.col(line), r"[\r\n]+$", "")
    parts = syslog_fields(F.col("raw"), F.col(sender) if sender else None)
    rows = lines.withColumn("raw", text).filter("raw <> ''")
    return rows.select("raw", parts["host"].alias("host"), parts["source"].alias("source"), parts["sourcetype"].alias("sourcetype"), F.lit(index).alias("index"), F.lit(0).cast("bigint").alias("timestamp_us"))
