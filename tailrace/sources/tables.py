"""Tables in other formats as sources, and results into them.

Parquet, ORC, JSON lines, CSV and text are built into Spark; Avro, JDBC and
Kafka work where the session has the connector, else the call says which one is
missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUILT_IN = ("parquet", "orc", "json", "csv", "text")
WITH_CONNECTOR = ("avro", "jdbc", "kafka")


def _checked(kind: str) -> str:
    if kind not in (*BUILT_IN, *WITH_CONNECTOR):
        raise ValueError(f"no format {kind!r}")
    return kind


def _missing(kind: str, e: Exception) -> Exception:
    if kind in WITH_CONNECTOR and any(x in str(e) for x in ("DATA_SOURCE_NOT_FOUND", "Failed to find data source", "ClassNotFoundException", "No suitable driver")):
        return RuntimeError(f"the session has no connector for {kind}")
    return e


def read_table(spark: SparkSession, kind: str, path: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A table to be registered as an index.  Text formats need a ``schema``, so that
    nothing is read to guess one."""
    reader = spark.read.format(_checked(kind)).options(**options)
    if kind in ("json", "csv"):
        if schema is None:
            raise ValueError(f"{kind} needs a schema")
        reader = reader.schema(schema)
    elif schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path) if path is not None else reader.load()
    except Exception as e:
        raise _missing(kind, e) from e


def write_table(df: DataFrame, kind: str, path: str | None = None, mode: str = "error", by: tuple[str, ...] = (), **options: str) -> None:
    """Writes a result, in folders by the columns ``by`` if given."""
    writer = df.write.format(_checked(kind)).mode(mode).options(**options)
    if by:
        writer = writer.partitionBy(*by)
    try:
        writer.save(path) if path is not None else writer.save()
    except Exception as e:
        raise _missing(kind, e) from e
