"""Files as sources: logs (once or as a stream), and tables of assets and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.sources.lines import sourcetype_of
from tailrace.sources.tail import tail

ASSET = "asset_id string, ip string, hostname string, mac string, os string, criticality string, business_unit string, location string, time_zone string"
IDENTITY = "username string, email string, full_name string, department string, manager string, priority string, risk_score double"
INDICATOR = "ioc_type string, ioc_value string, source string, confidence double, severity string, tlp string, first_seen timestamp, last_seen timestamp"


def _chosen(df: DataFrame, allow: str | None, deny: str | None) -> DataFrame:
    """Lines of the files whose path matches ``allow`` and not ``deny`` (regular expressions)."""
    path = F.col("_metadata.file_path")
    df = df.select("value", path.alias("path"))
    if allow:
        df = df.filter(F.col("path").rlike(allow))
    if deny:
        df = df.filter(~F.col("path").rlike(deny))
    return df


def _as_input(lines: DataFrame, index: str, host: str) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(
        F.col("value").alias("raw"), F.lit(host).alias("host"), F.col("path").alias("source"), sourcetype_of(F.col("path")).alias("sourcetype"), F.lit(index).alias("index"), F.lit(0).cast("bigint").alias("timestamp_us")
    )


def read_logs(spark: SparkSession, path: str, index: str = "main", host: str = "unknown", recursive: bool = True, allow: str | None = None, deny: str | None = None) -> DataFrame:
    """Non-empty lines of the files below ``path`` as input rows."""
    return _as_input(_chosen(spark.read.option("recursiveFileLookup", recursive).text(path), allow, deny), index, host)


def tail_logs(spark: SparkSession, path: str, index: str = "main", host: str = "unknown", allow: str | None = None, deny: str | None = None, max_files: int = 1000) -> DataFrame:
    """As :func:`read_logs`, as a stream of new files.  A file is read once, when it
    appears; for lines added to files see :func:`follow_logs`."""
    stream = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).text(path)
    return _as_input(_chosen(stream, allow, deny), index, host)


def follow_logs(spark: SparkSession, path: str, index: str = "main", host: str = "unknown", allow: str | None = None, deny: str | None = None) -> DataFrame:
    """As :func:`read_logs`, as a stream of the lines added to the files."""
    options = {k: v for k, v in (("allow", allow), ("deny", deny)) if v}
    return _as_input(tail(spark, path, **options), index, host)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of assets, identities or indicators from CSV with a header; malformed
    values become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)


def import_feed(spark: SparkSession, path: str, kind: str, source: str) -> DataFrame:
    """Indicators of a feed: csv or json as INDICATOR, stix as a bundle of objects
    with comparison patterns.  ``source`` names the feed where a row doesn't."""
    if kind == "csv":
        df = import_csv(spark, path, INDICATOR)
    elif kind == "json":
        df = spark.read.schema(INDICATOR).json(path)
    elif kind == "stix":
        bundle = spark.read.schema("objects array<struct<type:string,pattern:string,confidence:double,valid_from:timestamp,valid_until:timestamp>>").option("multiLine", True).json(path)
        o = bundle.select(F.explode("objects").alias("o")).filter("o.type = 'indicator'")
        kinds = {"ipv4-addr": "ip", "ipv6-addr": "ip", "domain-name": "domain", "file": "hash", "url": "url", "email-addr": "email"}
        named = F.regexp_extract("o.pattern", r"\[\s*([\w-]+):", 1)
        mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), named)
        df = o.select(
            mapped.alias("ioc_type"), F.regexp_extract("o.pattern", r"=\s*'([^']*)'", 1).alias("ioc_value"), F.lit(None).cast("string").alias("source"), (F.col("o.confidence") / 100).alias("confidence"),
            F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("tlp"), F.col("o.valid_from").alias("first_seen"), F.col("o.valid_until").alias("last_seen"),
        )
    else:
        raise ValueError(f"no feed of kind {kind!r}")
    return df.withColumn("source", F.coalesce("source", F.lit(source)))
