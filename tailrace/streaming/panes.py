"""Counts by event time over a stream, corrected as late records arrive.

The state is a table of panes, in slots of time.  A micro-batch is cut into
panes, and only the panes it touches get new rows in the table.  A window is
emitted when the stream's clock (the latest receipt) has reached its end and
the grace; from then on it is recomposed and emitted again whenever a batch
changes one of its panes.  Only the slots of the windows to emit are read.  A
batch that is repeated after a failure overwrites what it wrote before.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tailrace.io import Commits, hadoop
from tailrace.operators.panes import PaneSpec, assign, receipt_counts, window_ticks

#: Batches that lie side by side before they are added up.
MOST_BATCHES = 16
#: Windows of one slot of time.
SLOT_WINDOWS = 24


class PaneStore:
    """Pane counts and emitted windows below ``path``, in a folder for each batch.

    After MOST_BATCHES folders those of finished batches are added up into a base,
    which counts from a numbered commit on; what it holds is then deleted."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], spec: PaneSpec, most_batches: int = MOST_BATCHES):
        self.spark, self.path, self.keys, self.spec, self.most_batches = spark, path.rstrip("/"), keys, spec, most_batches
        self.slot_us = spec.size_us * SLOT_WINDOWS
        self.commits = Commits(spark, f"{self.path}/bases")

    def _schema(self, more: str) -> str:
        return ", ".join(f"`{k}` {t}" for k, t in self.keys.items()) + ", " + more

    def _folders(self, part: str) -> list[str]:
        """The base and the batches that it doesn't hold, oldest first."""
        last = self.commits.last()
        upto, base = (last[1]["upto"], [f"{self.path}/{last[1][part]}"]) if last else (-1, [])
        at, fs = hadoop(self.spark, f"{self.path}/{part}")
        names = [str(s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
        batches = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
        return base + [f"{self.path}/{part}/batch={n}" for n in batches if n > upto]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # each folder is a table of its own, partitioned by slot
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f) for f in folders])

    def _clock(self, batch: int) -> int | None:
        """The latest receipt before ``batch``."""
        found = [r.clock for r in self._read([f for f in self._folders("clocks") if not f.endswith(f"batch={batch}")], "clock bigint").collect() if r.clock is not None]
        return max(found, default=None)

    def panes(self) -> DataFrame:
        df = self._read(self._folders("panes"), self._schema("pane_us bigint, late_us bigint, n bigint, slot bigint"))
        return df.groupBy(*self.keys, "slot", "pane_us", "late_us").agg(F.sum("n").alias("n"))

    def _slot(self, us: Column) -> Column:
        return F.floor(us / F.lit(self.slot_us)).cast("bigint")

    def take(self, assigned: DataFrame, batch: int) -> None:
        """Adds one batch: changed panes are written; emitted are the windows over them
        whose cut-off its rows kept, and those that the clock has now reached."""
        self._compact(batch)
        was = self._clock(batch)
        at = f"{self.path}/panes/batch={batch}"
        received = F.max(F.col("lateness_us") + F.col("pane_us") + self.spec.pane_us).alias("seen")
        receipts = receipt_counts(assigned, list(self.keys), self.spec, (received,)).withColumn("slot", self._slot(F.col("pane_us")))
        receipts.write.mode("overwrite").partitionBy("slot").parquet(at)
        touched = self.spark.read.schema(self._schema("pane_us bigint, late_us bigint, n bigint, seen bigint, slot bigint")).parquet(at)
        now = max((c for c in (was, touched.agg(F.max("seen").alias("m")).first().m) if c is not None), default=None)
        self.spark.createDataFrame([(now,)], "clock bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clocks/batch={batch}")
        windows = window_ticks(touched, self.spec).filter("tick >= 0").select(*self.keys, "window_us").distinct()
        self._emit(windows, was, now, batch)

    def _emit(self, windows: DataFrame | None, was: int | None, now: int | None, batch: int) -> None:
        """Emits those of ``windows`` that are due at ``now``, and all that became due since ``was``."""
        lead = self.spec.size_us + self.spec.grace_us
        top = F.lit(now).cast("bigint") - lead
        new = F.col("window_us") <= top if was is None else (F.col("window_us") <= top) & (F.col("window_us") > F.lit(was - lead))
        slots: set[int] = set()
        if windows is not None:
            reach = F.sequence(self._slot(F.col("window_us")), self._slot(F.col("window_us") + self.spec.size_us - 1))
            # as many as there are slots of time among the changed windows
            slots |= {r.s for r in windows.filter(F.col("window_us") <= top).select(F.explode(reach).alias("s")).distinct().collect()}
        every = self.panes()
        last_slot = None if now is None else (now - self.spec.grace_us) // self.slot_us
        first_slot = None if was is None else (was - lead) // self.slot_us
        in_reach = F.col("slot").isin(sorted(slots)) if slots else F.lit(False)
        if last_slot is not None:
            recent = F.col("slot") <= last_slot
            in_reach = in_reach | (recent if first_slot is None else recent & (F.col("slot") >= first_slot))
        ticks = window_ticks(every.filter(in_reach), self.spec).filter("tick >= 0").withColumn("__new", new)
        if windows is None:
            again = ticks.filter("__new")
        else:
            marks = windows.withColumn("__touched", F.lit(True)).withColumnsRenamed({k: f"__{k}" for k in (*self.keys, "window_us")})
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], F.col("window_us") == F.col("__window_us"))
            again = ticks.join(marks, same, "left").filter((F.col("__new") | F.coalesce("__touched", F.lit(False))) & (F.col("window_us") <= top))
        again.groupBy(*self.keys, "window_us").agg(F.sum("n").alias("n")).withColumn("at", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/emitted/batch={batch}")

    def flush(self) -> None:
        """Emits all windows that wait for the clock, at the end of a stream."""
        done = [int(f.rsplit("=", 1)[1]) for f in self._folders("panes") if "/batch=" in f]
        last = self.commits.last()
        batch = max([*done, last[1]["upto"] if last else -1]) + 1
        was, end = self._clock(batch), self.panes().agg(F.max("pane_us").alias("m")).first().m
        if end is not None:
            now = end + self.spec.size_us + self.spec.grace_us
            self._emit(None, was, max(now, was or now), batch)

    def emitted(self) -> DataFrame:
        """(keys, window_us, n, at): every emission that is kept, ``at`` its batch."""
        return self._read(self._folders("emitted"), self._schema("window_us bigint, n bigint, at bigint"))

    def current(self) -> DataFrame:
        """The last emission of each window."""
        return self.emitted().groupBy(*self.keys, "window_us").agg(F.max_by("n", "at").alias("n"))

    def _compact(self, batch: int) -> None:
        """Adds up the batches before ``batch``, which are finished, if they are many."""
        folders = self._folders("panes")
        done = [int(f.rsplit("=", 1)[1]) for f in folders if "/batch=" in f]
        done = [n for n in done if n < batch]
        if len(done) < self.most_batches:
            return
        last = self.commits.last()
        number, name = (last[0] + 1 if last else 1), uuid.uuid4().hex
        whole = [f for f in folders if "/batch=" not in f or int(f.rsplit("=", 1)[1]) < batch]
        schema = self._schema("pane_us bigint, late_us bigint, n bigint, slot bigint")
        self._read(whole, schema).groupBy(*self.keys, "slot", "pane_us", "late_us").agg(F.sum("n").alias("n")).write.partitionBy("slot").parquet(f"{self.path}/base-{name}/panes")
        of = lambda part: [f for f in self._folders(part) if "/batch=" not in f or int(f.rsplit("=", 1)[1]) < batch]
        emitted = self._read(of("emitted"), self._schema("window_us bigint, n bigint, at bigint")).groupBy(*self.keys, "window_us").agg(F.max_by("n", "at").alias("n"), F.max("at").alias("at"))
        emitted.write.parquet(f"{self.path}/base-{name}/emitted")
        self._read(of("clocks"), "clock bigint").agg(F.max("clock").alias("clock")).write.parquet(f"{self.path}/base-{name}/clocks")
        old = [last[1]["panes"].split("/")[0]] if last else []
        self.commits.publish(number, {"upto": max(done)} | {part: f"base-{name}/{part}" for part in ("panes", "emitted", "clocks")})
        for folder in [*old, *(f"{part}/batch={n}" for part in ("panes", "emitted", "clocks") for n in done)]:
            path, fs = hadoop(self.spark, f"{self.path}/{folder}")
            fs.delete(path, True)


def start(events: DataFrame, event_us: Column, received_us: Column, keys: list[str], spec: PaneSpec, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs a stream of rows into a :class:`PaneStore`."""
    store = PaneStore(events.sparkSession, path, {k: dict(events.dtypes)[k] for k in keys}, spec)
    out = assign(events, event_us, received_us, spec).writeStream.foreachBatch(lambda df, n: store.take(df, n)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()


def watermarked_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", cutoff: str = "12 hours") -> DataFrame:
    """The built-in form: counts by window, updated until the watermark passes."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, cutoff).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
