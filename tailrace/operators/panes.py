"""Late and out-of-order events (problem 1): counts by event time from panes.

Event time is cut into non-overlapping panes at the granularity of the window
boundaries.  A record changes exactly one pane, a window is the sum of the
panes it covers.  A late record therefore recomposes only the windows over its
pane, and each of them is emitted again with the next version.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.instants import micros_of_number

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


class PaneSpec:
    """Windows of ``size_us`` every ``slide_us``, first emitted ``grace_us`` after
    their end, corrected every ``tick_us`` until ``cutoff_us`` after it."""

    def __init__(self, size_us: int = HOUR_US, slide_us: int | None = None, grace_us: int = 10 * MINUTE_US, cutoff_us: int = 12 * HOUR_US, tick_us: int = HOUR_US):
        self.size_us = size_us
        self.slide_us = slide_us or size_us
        self.grace_us = grace_us
        self.cutoff_us = cutoff_us
        self.tick_us = tick_us
        self.pane_us = gcd(self.size_us, self.slide_us)
        # lateness rounded down to this changes neither fate nor tick of any window
        self.step_us = gcd(self.pane_us, self.grace_us, self.cutoff_us, self.tick_us)


def pane_of(event_us: Column, pane_us: int) -> Column:
    return event_us - F.pmod(event_us, F.lit(pane_us))


def assign(rows: DataFrame, event_us: Column, received_us: Column, spec: PaneSpec) -> DataFrame:
    """Adds ``event_us``, ``pane_us``, ``lateness_us`` (receipt after the pane's end) and ``fate``.

    ``fate`` is that of the pane taken as a window of its own: 'first' (in the
    first emission), 'corrects' (re-emits it) or 'dropped' (past the cut-off).
    Longer windows end later, see :func:`window_ticks`.  All three are null for
    rows without an event time; ``fate`` is 'first' for rows without a receipt.
    """
    pane = pane_of(F.col("event_us"), spec.pane_us)
    late = F.col("lateness_us")
    return (
        rows.withColumn("event_us", event_us)
        .withColumn("pane_us", pane)
        .withColumn("lateness_us", received_us - F.col("pane_us") - spec.pane_us)
        .withColumn(
            "fate",
            F.when(F.col("event_us").isNull(), None).when(late >= spec.cutoff_us, "dropped").when(late >= spec.grace_us, "corrects").otherwise("first"),
        )
    )


def assign_ingest(ingest: DataFrame, spec: PaneSpec | None = None) -> DataFrame:
    """:func:`assign` for ingest rows as they stand; a time of null or 0 is none."""
    stated = F.when(F.col("timestamp_us") != 0, F.col("timestamp_us"))
    return assign(ingest, micros_of_number(stated), F.col("received_us"), spec or PaneSpec())


def pane_counts(assigned: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """(keys, pane_us, tick, n): how many rows each correction round adds to each pane.

    Tick 0 is the first emission.  Dropped rows are counted under tick -1.  The
    partial counts before the shuffle leave one row a pane and tick of each
    task, so hot keys do no harm.
    """
    tick = F.when(F.col("fate") == "first", 0).when(F.col("fate") == "dropped", -1).otherwise(F.call_function("div", F.col("lateness_us"), F.lit(spec.tick_us)) + 1)
    return assigned.filter(F.col("fate").isNotNull()).groupBy(*keys, "pane_us", tick.cast("int").alias("tick")).agg(F.count(F.lit(1)).alias("n"))


def windows_of(panes: DataFrame, spec: PaneSpec) -> DataFrame:
    """Panes repeated for each window that covers them, ``window_us`` its start."""
    covering = spec.size_us // spec.slide_us + (1 if spec.size_us % spec.slide_us else 0)
    last = F.col("pane_us") - F.pmod(F.col("pane_us"), F.lit(spec.slide_us))
    starts = F.array(*[last - k * spec.slide_us for k in range(covering)])
    return panes.withColumn("window_us", F.explode(starts)).filter(F.col("pane_us") + spec.pane_us <= F.col("window_us") + spec.size_us)


def late_step(late: Column, spec: PaneSpec) -> Column:
    """Lateness against the pane's end in whole steps; null for rows in the first
    emission of every window, and no more than what is past every cut-off."""
    steps = F.least(late - F.pmod(late, F.lit(spec.step_us)), F.lit(spec.cutoff_us + spec.size_us - spec.pane_us))
    return F.when(late >= spec.grace_us, steps)


def receipt_counts(assigned: DataFrame, keys: list[str], spec: PaneSpec, more: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, pane_us, late_us, n): how many rows of each pane were received how late;
    with ``more`` aggregates of these rows.

    ``late_us`` is the lateness against the pane's end in whole steps, null for
    rows in the first emission of every window, and no more than the value that
    is past the cut-off of every window; so a pane has a bounded number of rows.
    """
    return assigned.filter("event_us is not null").groupBy(*keys, "pane_us", late_step(F.col("lateness_us"), spec).alias("late_us")).agg(F.count(F.lit(1)).alias("n"), *more)


def window_ticks(receipts: DataFrame, spec: PaneSpec) -> DataFrame:
    """:func:`receipt_counts` repeated for each window over the pane, with the ``tick``
    in which the rows enter that window: counted from the window's end, 0 in its
    first emission and -1 past its cut-off."""
    late = F.col("late_us") - (F.col("window_us") + spec.size_us - F.col("pane_us") - spec.pane_us)
    tick = F.when(late >= spec.cutoff_us, -1).when(late >= spec.grace_us, F.call_function("div", late, F.lit(spec.tick_us)) + 1).otherwise(0)
    return windows_of(receipts, spec).withColumn("tick", tick.cast("int"))


def window_emissions(assigned: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """:func:`emissions` with grace, ticks and cut-off counted from the end of each
    window: a row is dropped only for the windows whose own cut-off it missed."""
    return _versions(window_ticks(receipt_counts(assigned, keys, spec), spec).filter("tick >= 0"), keys)


def emissions(panes: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """(keys, window_us, version, tick, n_added, n): every emission of every window,
    with the ticks of its panes; for windows longer than a pane
    :func:`window_emissions` counts from the window's end.

    Version 0 is the first; each later tick with corrections gives one more,
    with the corrected count ``n``.  There are at most cutoff/tick versions of
    a window.
    """
    return _versions(windows_of(panes.filter("tick >= 0"), spec), keys)


def _versions(ticks: DataFrame, keys: list[str]) -> DataFrame:
    per = ticks.groupBy(*keys, "window_us", "tick").agg(F.sum("n").alias("n_added"))
    w = Window.partitionBy(*keys, "window_us").orderBy("tick")
    return per.select(*keys, "window_us", (F.row_number().over(w) - 1).alias("version"), "tick", "n_added", F.sum("n_added").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def final_counts(assigned: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """(keys, period_us, n_first, n_corrected, n_dropped, n): the last state of each pane."""
    panes = pane_counts(assigned, keys, spec)
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        panes.groupBy(*keys, F.col("pane_us").alias("period_us"))
        .agg(of(F.col("tick") == 0).alias("n_first"), of(F.col("tick") > 0).alias("n_corrected"), of(F.col("tick") < 0).alias("n_dropped"))
        .withColumn("n", F.col("n_first") + F.col("n_corrected"))
    )


def late_changes(assigned: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """(keys, pane_us, late_us, window_us, tick): what late rows do to the panes, one row
    for each pane, step of lateness and window over it: the round in which the
    window is recomposed and emitted again, or -1 past its cut-off."""
    late = receipt_counts(assigned, keys, spec).filter("late_us is not null")
    return window_ticks(late, spec).filter("tick <> 0").select(*keys, "pane_us", "late_us", "window_us", "tick")


def late_rows(assigned: DataFrame, keys: list[str], spec: PaneSpec) -> DataFrame:
    """``assigned`` rows that change a pane after a window over it was first emitted,
    once for each such window, with ``window_us`` and ``tick``.

    The rows meet the changes of their panes, which are one row a pane and step
    of lateness; keys are compared null-safe."""
    changes = late_changes(assigned, keys, spec).withColumnsRenamed({k: f"__{k}" for k in (*keys, "pane_us", "late_us")})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], (F.col("pane_us") == F.col("__pane_us")) & (F.col("late_us") == F.col("__late_us")))
    rows = assigned.withColumn("late_us", late_step(F.col("lateness_us"), spec)).filter("event_us is not null and late_us is not null")
    return rows.join(changes, same).drop("late_us", *[f"__{k}" for k in (*keys, "pane_us", "late_us")])


def found(ingest: DataFrame) -> DataFrame:
    """(ingest_id, period_us, fate): late rows with the hour whose pane they change and
    what becomes of them: the hour is corrected, or its cut-off has passed."""
    spec = PaneSpec()
    late = late_rows(assign_ingest(ingest, spec), ["index_name"], spec)
    return late.select("ingest_id", F.col("window_us").alias("period_us"), F.when(F.col("tick") > 0, "corrects").otherwise("dropped").alias("fate"))


def segment_ranges(ingest: DataFrame, segments: DataFrame) -> DataFrame:
    """``segments`` with ranges and counts recomputed from their rows.

    (segment_id, earliest_time, latest_time, event_count, agrees): rows without
    a time count but don't widen the range; a segment without rows has null
    bounds and count 0.  ``agrees`` tells whether the stored range was right
    (null or 0 bounds agree with an empty range only).
    """
    rows = assign_ingest(ingest).groupBy("segment_id").agg(F.min("event_us").alias("lo"), F.max("event_us").alias("hi"), F.count(F.lit(1)).alias("n"))
    joined = segments.select("segment_id", F.nullif(F.col("earliest_time"), F.lit(0)).alias("e"), F.nullif(F.col("latest_time"), F.lit(0)).alias("l")).join(rows, "segment_id", "left")
    return joined.select(
        "segment_id",
        F.col("lo").alias("earliest_time"),
        F.col("hi").alias("latest_time"),
        F.coalesce("n", F.lit(0)).alias("event_count"),
        (F.col("e").eqNullSafe(F.col("lo")) & F.col("l").eqNullSafe(F.col("hi"))).alias("agrees"),
    )
