"""Mixed timestamp formats and zones: one instant for each record (problem 4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions.instants import micros_of_number, nearest, time_text, written_instants
from tailrace.io import Commits, Taken, hadoop, host_key, scratch, small

KEY = ("time_text", "zone", "receipt_year")
#: Folders of a dictionary that are read side by side before they are written into one.
MOST_PARTS = 16


class TimeDictionary:
    """Distinct (written time, zone, year of receipt) -> instants, kept as a table.

    ``update`` parses only combinations that the table lacks and adds them as a
    folder of its own; each is parsed once, however many rows and runs it occurs
    in.  A state of the table is the list of folders that a numbered commit
    names; one writer only can take a number.  A writer that comes second looks
    for what is new again, against the state of the first, so no key has two
    rows.  When a state has MOST_PARTS folders the next update writes them into
    one.  Null keys never enter.
    """

    SCHEMA = "time_text string, zone string, receipt_year int, instants array<bigint>"

    def __init__(self, spark, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def parts(self) -> list[str]:
        """Folders of the newest state."""
        last = self.commits.last()
        return last[1]["parts"] if last else []

    def _table(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        return self._table(self.parts())

    def missing(self, keys: DataFrame) -> DataFrame:
        """What of ``keys`` (columns KEY) the table lacks, each once."""
        new = keys.select(*KEY).dropna().distinct()
        parts = self.parts()
        return new.join(self._table(parts), list(KEY), "left_anti") if parts else new

    def update(self, keys: DataFrame) -> DataFrame:
        """Adds what is new in ``keys`` (columns KEY) and returns the table."""
        while True:
            last = self.commits.last()
            number, parts = (last[0] + 1, last[1]["parts"]) if last else (1, [])
            parsed = self.missing(keys).withColumn("instants", written_instants(F.col("time_text"), F.col("zone"), F.col("receipt_year")))
            if len(parts) >= MOST_PARTS:
                parsed, parts = self._table(parts).unionByName(parsed), []
            new = f"part-{number:012d}-{uuid.uuid4().hex}"
            parsed.write.parquet(f"{self.path}/{new}")
            if parts and self._table([new]).isEmpty():  # nothing was new
                at, fs = hadoop(self.spark, f"{self.path}/{new}")
                fs.delete(at, True)
                return self._table(parts)
            try:
                self.commits.publish(number, {"parts": [*parts, new]})
            except Taken:
                at, fs = hadoop(self.spark, f"{self.path}/{new}")
                fs.delete(at, True)
                continue
            return self._table([*parts, new])


def host_zones(assets: DataFrame) -> DataFrame:
    """(host_key, zone), one row a host: the zone of its wall clock where one is
    given (the least if several are)."""
    return (
        assets.select(host_key(F.col("hostname")).alias("host_key"), F.col("time_zone").alias("zone"))
        .dropna()
        .groupBy("host_key")
        .agg(F.min("zone").alias("zone"))
    )


def normalise_written_times(rows: DataFrame, assets: DataFrame, raw: str, host: str, received_us: str, dictionary: TimeDictionary | None = None) -> DataFrame:
    """``rows`` with ``written_us``: the instant that column ``raw`` states, or null.

    Written times are deduplicated with zone and year of receipt, parsed once
    into the dictionary and joined back.  Zone: as written, else the wall clock
    of ``host`` by ``assets``, else UTC.  A missing year is the one nearest to
    ``received_us``; without a receipt it can't be told and the result is null.
    Rows without text keep null.  Columns of ``rows`` are kept; the names
    beginning with ``__`` are taken.
    """
    zones = small(host_zones(assets).select(F.col("host_key").alias("__host"), F.col("zone").alias("__zone")))
    keyed = (
        rows.withColumn("__text", F.nullif(time_text(F.col(raw)), F.lit("")))
        .withColumn("__host", host_key(F.col(host)))
        .join(zones, "__host", "left")
        .withColumn("__zone", F.coalesce("__zone", F.lit("UTC")))
        .withColumn("__year", F.year(F.timestamp_micros(F.coalesce(F.col(received_us), F.lit(0)))))
        .drop("__host")
    )
    dictionary = dictionary or TimeDictionary(rows.sparkSession, scratch(rows.sparkSession, "times"))
    known = dictionary.update(keyed.select(F.col("__text").alias("time_text"), F.col("__zone").alias("zone"), F.col("__year").alias("receipt_year")))
    known = known.select(F.col("time_text").alias("__text"), F.col("zone").alias("__zone"), F.col("receipt_year").alias("__year"), F.col("instants").alias("__instants"))
    at = F.col(received_us)
    picked = F.when(F.size("__instants") == 1, F.col("__instants")[0]).otherwise(nearest(F.col("__instants"), at))
    return keyed.join(known, ["__text", "__zone", "__year"], "left").withColumn("written_us", picked).drop("__text", "__zone", "__year", "__instants")


def stated_instant(seconds: Column, microseconds: Column) -> tuple[Column, Column]:
    """(instant in us, whether a part was in a finer unit) of a seconds/microseconds
    pair; the instant is null where seconds is null or 0."""
    given = F.when(seconds != 0, seconds)
    part = F.coalesce(microseconds.cast("long"), F.lit(0).cast("long"))
    finer = (given >= 10**11) | (part > 999_999)
    part_us = F.when(part > 999_999, F.call_function("div", part, F.lit(1_000))).otherwise(part)
    return micros_of_number(given) + part_us, F.coalesce(finer, F.lit(False))


def wire_rows(wire: DataFrame) -> DataFrame:
    """(table_name, rec_id, raw, host, received_us, stated_us, finer) of wire rows:
    the instant stated as a number, and whether it was in a finer unit."""
    stated, finer = stated_instant(F.col("event_time.seconds"), F.col("event_time.microseconds"))
    received = F.unix_micros(F.col("received_at").cast("timestamp"))
    return wire.select(F.lit("wire_event").alias("table_name"), F.col("delivery_id").alias("rec_id"), "raw", "host", received.alias("received_us"), stated.alias("stated_us"), finer.alias("finer"))


def ingest_rows(ingest: DataFrame) -> DataFrame:
    """As :func:`wire_rows`, of ingest rows."""
    n = F.when(F.col("timestamp_us") != 0, F.col("timestamp_us"))
    other_unit = F.coalesce((n < 10**14) | (n >= 10**17), F.lit(False))
    return ingest.select(F.lit("ingest_event").alias("table_name"), F.col("ingest_id").alias("rec_id"), "raw", "host", "received_us", micros_of_number(n).alias("stated_us"), other_unit.alias("finer"))


def normalise(rows: DataFrame, assets: DataFrame, dictionary: TimeDictionary | None = None, only_repaired: bool = False) -> DataFrame:
    """(table_name, rec_id, event_us, repaired): one instant for each of ``rows`` (as
    :func:`wire_rows`), null where none is known.  ``repaired``: it was missing or
    in another unit; ``only_repaired`` leaves the others out."""
    given = rows.filter(F.col("stated_us").isNotNull()).select("table_name", "rec_id", F.col("stated_us").alias("event_us"), F.col("finer").alias("repaired"))
    if only_repaired:
        given = given.filter("repaired")
    missing = rows.filter(F.col("stated_us").isNull()).select("table_name", "rec_id", "raw", "host", "received_us")
    written = normalise_written_times(missing, assets, "raw", "host", "received_us", dictionary)
    return given.unionByName(written.select("table_name", "rec_id", F.col("written_us").alias("event_us"), F.lit(True).alias("repaired")))


def found(wire: DataFrame, ingest: DataFrame, assets: DataFrame, dictionary: TimeDictionary | None = None) -> DataFrame:
    """Rows whose time was missing or in another unit, with the normalised instant.

    Written times go through ``dictionary``; one kept from earlier runs spares
    the parsing of what these have met."""
    rows = wire_rows(wire).unionByName(ingest_rows(ingest))
    return normalise(rows, assets, dictionary, only_repaired=True).filter(F.col("event_us").isNotNull()).select("table_name", "rec_id", "event_us")
