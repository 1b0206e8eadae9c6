"""Rules over a stream: every micro-batch is one scan for all rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tailrace.detect.engine import matches
from tailrace.detect.rules import Rule
from tailrace.plans.catalog import Catalog


def watch(events: DataFrame, rules: Iterable[Rule], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Gives ``sink`` the (rule_id, host, n) of each micro-batch of events in the
    event model, with the number of the batch; a batch that is repeated after a
    failure has the same number.

    These are matches: the threshold of a rule holds for counts summed over
    batches, to which ``engine.over_threshold`` applies it."""
    rules = tuple(rules)

    def batch(df: DataFrame, number: int) -> None:
        catalog = Catalog(df.sparkSession)
        catalog.register("main", df)
        sink(matches(catalog, rules), number)

    out = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="60 seconds")).start()
