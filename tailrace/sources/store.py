"""The event store: Parquet, one folder for each index and day."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_STORE = "_time timestamp, _id bigint, host string, source string, sourcetype string, _raw string, fields map<string,string>, index string, date date"
TARGET_BYTES = 256 * 1024 * 1024
MIN_FILES = 3
#: Distinct values that a row group's bloom filter is made for.
BLOOM_VALUES = 10_000


class EventStore:
    """Events below ``path``, partitioned by index and date, sorted by time in each
    file so that row groups can be skipped by their time range."""

    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd", bloom: tuple[str, ...] = ("host",), level: int | None = None, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target_bytes = spark, path.rstrip("/"), target_bytes
        self.options = {"compression": codec} | {f"parquet.bloom.filter.{k}#{c}": v for c in bloom for k, v in (("enabled", "true"), ("expected.ndv", str(BLOOM_VALUES)))}
        if level is not None and codec == "zstd":
            self.options["parquet.compression.codec.zstd.level"] = str(level)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return bool(self._fs.exists(self._at(self.path)))

    def append(self, events: DataFrame, batch: str | None = None) -> None:
        """Adds normalised events, brought together by index and day so that few files
        are written; adaptive execution cuts a hot day into several and joins small ones.

        With ``batch``, a name, the events are added once however often the call is
        repeated: they are written aside, the moves are planned in a file, and a
        call that finds a plan goes on with it."""
        write = events.hint("rebalance", F.col("index"), F.col("date")).sortWithinPartitions("index", "date", "_time").write.options(**self.options).partitionBy("index", "date")
        if batch is None:
            write.mode("append").parquet(self.path)
            return
        done, plan, staged = (f"{self.path}/_batches/{batch}{x}" for x in (".done", ".plan", ""))
        if self._fs.exists(self._at(done)):
            return
        if not self._fs.exists(self._at(plan)):
            write.mode("overwrite").parquet(staged)
            files = [str(f) for i in self._folders(staged, "index=") for d in self._folders(i, "date=") for f in self._files(d)]
            place = lambda k, f: f"{self.path}/{'/'.join(f.rsplit('/', 3)[1:3])}/{batch}-{k:05d}.parquet"
            self._put(plan, {"moves": [[f, place(k, f)] for k, f in enumerate(files)]})
        self._move(self._get(plan)["moves"])
        self._put(done, {})
        self._fs.delete(self._at(staged), True)
        self._fs.delete(self._at(plan), False)

    def _put(self, path: str, content: dict) -> None:
        """A file that is there in full or not at all."""
        hidden = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(hidden))
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(self._at(hidden), self._at(path)):
            raise OSError(f"{path} could not be written")

    def _get(self, path: str) -> dict:
        stream = self._fs.open(self._at(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _move(self, moves: list[list[str]]) -> None:
        """Renames files; what was moved before is left as it is."""
        for source, target in moves:
            if not self._fs.exists(self._at(source)):
                if not self._fs.exists(self._at(target)):
                    raise OSError(f"{source} is gone")
                continue
            self._fs.mkdirs(self._at(target).getParent())
            if not self._fs.rename(self._at(source), self._at(target)):
                raise OSError(f"{source} could not be moved to {target}")

    def _folders(self, path: str, prefix: str) -> list[str]:
        at = self._at(path)
        return [str(s.getPath()) for s in self._fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix)] if self._fs.exists(at) else []

    def _files(self, folder: str) -> list[str]:
        return [str(f.getPath()) for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().endswith(".parquet") and not f.getPath().getName().startswith((".", "_"))]

    def read(self, index: str | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """Events of the store; bounds on index and day prune folders."""
        if not self.exists():
            return self.spark.createDataFrame([], EVENT_STORE)
        at = self.path if index is None else f"{self.path}/index={index}"
        known = index is not None and self._fs.exists(self._at(at))
        # only the folder of the index is listed, if its name is written as it is
        df = self.spark.read.schema(EVENT_STORE).option("basePath", self.path).parquet(at if known else self.path)
        if index is not None:
            df = df.filter(F.col("index") == index)
        if first_day is not None:
            df = df.filter(F.col("date") >= F.lit(first_day).cast("date"))
        if last_day is not None:
            df = df.filter(F.col("date") <= F.lit(last_day).cast("date"))
        return df

    def indexes(self) -> list[str]:
        if not self.exists():
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)) if s.isDirectory()]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("index="))

    def statistics(self) -> DataFrame:
        """(name, total_events, total_size_bytes, segment_count) of each index."""
        return (
            self.read()
            .select("index", F.octet_length("_raw").alias("b"), F.col("_metadata.file_path").alias("file"))
            .groupBy("index", "file")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
            .groupBy(F.col("index").alias("name"))
            .agg(F.sum("n").alias("total_events"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_size_bytes"), F.count(F.lit(1)).alias("segment_count"))
        )

    def compact(self, target_bytes: int | None = None, min_files: int = MIN_FILES) -> list[str]:
        """Rewrites folders that hold at least ``min_files`` files of less than half the
        target on average into files of about ``target_bytes``, sorted by time.
        Returns the folders.

        Only files that were listed at the start are rewritten and deleted; what is
        appended meanwhile stays.  The new files are complete and the moves planned in
        a file before anything is touched.  A call that fails after that is finished
        by :meth:`recover`, which each call begins with; until then, and for a moment
        in every call, readers may see rows of the folder twice, never none."""
        target_bytes = target_bytes or self.target_bytes
        self.recover()
        done = []
        for folder in [d for i in self._folders(self.path, "index=") for d in self._folders(i, "date=")]:
            files = self._files(folder)
            size = sum(self._fs.getFileStatus(self._at(f)).getLen() for f in files)
            if len(files) < min_files or size / len(files) >= target_bytes / 2:
                continue
            n = max(1, math.ceil(size / target_bytes))
            # names that begin with an underscore are no part of the table
            name = uuid.uuid4().hex
            aside = f"{self.path}/_compacting/{name}"
            df = self.spark.read.parquet(*files)
            df = df.repartitionByRange(n, "_time") if n > 1 else df.coalesce(1)
            df.sortWithinPartitions("_time").write.options(**self.options).parquet(aside)
            moves = [[f, f"{folder}/compact-{name}-{k:05d}.parquet"] for k, f in enumerate(self._files(aside))]
            self._put(f"{aside}.plan", {"moves": moves, "old": files})
            self.recover()
            done.append(folder)
        return done

    def recover(self) -> int:
        """Finishes planned compactions, and deletes what failed ones left; returns how many were planned."""
        at = self._at(f"{self.path}/_compacting")
        names = [str(s.getPath()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        plans = [n for n in names if n.endswith(".plan")]
        for plan in plans:
            todo = self._get(plan)
            self._move(todo["moves"])
            for old in todo["old"]:
                self._fs.delete(self._at(old), False)
            self._fs.delete(self._at(plan.removesuffix(".plan")), True)
            self._fs.delete(self._at(plan), False)
        for left in names:
            if ".plan" not in left and self._fs.exists(self._at(left)):
                self._fs.delete(self._at(left), True)
        return len(plans)

    def retain(self, index: str, first_day: str) -> int:
        """Drops the days of ``index`` before ``first_day``; returns how many."""
        at = self._at(f"{self.path}/index={index}")
        if not self._fs.exists(at):
            return 0
        n = 0
        for d in self._fs.listStatus(at):
            name = d.getPath().getName()
            if name.startswith("date=") and name[5:] < first_day:
                self._fs.delete(d.getPath(), True)
                n += 1
        return n

    def drop_index(self, index: str) -> bool:
        return bool(self._fs.delete(self._at(f"{self.path}/index={index}"), True))

    def deduplicate(self, index: str) -> DataFrame:
        """Events of ``index`` with one copy of each id (copies are equal, as the id is
        a hash of the event)."""
        return self.read(index).dropDuplicates(["_id"])
