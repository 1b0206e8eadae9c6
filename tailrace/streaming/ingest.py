"""Streams into the event store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tailrace.sources.normalise import normalise
from tailrace.sources.store import EventStore

#: A buffer is written out every so often.
PERIOD = "5 seconds"


def write_events(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of input rows to the store at ``path``, each exactly once: the
    checkpoint tells which input a batch holds, and the store takes a batch of
    that name once.  Other writers may append to the same store."""
    name = "s" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    store = EventStore(events.sparkSession, path)
    out = events.writeStream.foreachBatch(lambda df, n: store.append(normalise(df), f"{name}-{n:09d}")).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=PERIOD)).start()


def without_repeats(events: DataFrame, time: str, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """A stream without rows whose ``keys`` came before, as far back as ``lateness``
    (state for older ones is dropped)."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
