"""Where tables are read and intermediate results are kept."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows and bytes stay under these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset a temporary folder of this machine
    is set and used, but only if all executors run in this process; on a
    cluster the setting is demanded.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at, fs = hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(path, file system) of the JVM for ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and
    safe from the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes
    of text in them, else as it is.

    The measuring stops at ``rows + 1``; beyond the bounds Spark shuffles both sides.
    """
    width = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0))
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))).cast("bigint"), F.lit(0))
        else:
            width = width + 8
    r = df.limit(rows + 1).select(width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")).first()
    return F.broadcast(df) if r.n <= rows and (r.b or 0) <= size else df


class Taken(RuntimeError):
    """Another writer has published the same version."""


class Commits:
    """Numbered versions below a folder, each a small JSON file that one writer only
    can create: a version is written in full under a hidden name and then renamed
    without overwriting (one atomic step where the file system has it, as HDFS and
    local disks do)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> tuple[int, dict] | None:
        """(number, content) of the newest version."""
        at, fs = hadoop(self.spark, self.path)
        if not fs.exists(at):
            return None
        numbers = [int(n) for n in (str(s.getPath().getName()) for s in fs.listStatus(at)) if n.isdigit()]
        if not numbers:
            return None
        stream = fs.open(hadoop(self.spark, f"{self.path}/{max(numbers):012d}")[0])
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def publish(self, number: int, content: dict) -> None:
        """Makes ``content`` version ``number``; raises :class:`Taken` if there is one."""
        jvm = self.spark.sparkContext._jvm
        final, fs = hadoop(self.spark, f"{self.path}/{number:012d}")
        hidden, _ = hadoop(self.spark, f"{self.path}/.{number:012d}-{uuid.uuid4().hex}")
        if fs.exists(final):
            raise Taken(f"version {number} below {self.path} is taken")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(hidden, final, plain)
        except Exception as e:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(f"version {number} below {self.path} is taken") from None
            raise


def host_key(host: Column) -> Column:
    """Host names as they are compared: letter case, outer blanks and a
    trailing dot are disregarded; null stays null."""
    return F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
