"""Queries over the test tables, by problem: core part, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace import written_sql
from tailrace.io import table
from tailrace.operators import entries, instants, merkle, once, panes

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark, d):
    return panes.found(table(spark, d, "ingest_event"))


def _p1_hourly_counts(spark, d):
    spec = panes.PaneSpec()
    return panes.final_counts(panes.assign_ingest(table(spark, d, "ingest_event"), spec), ["index_name"], spec)


def _p1_emissions(spark, d):
    """Windows of three hours each hour, with every corrected emission; lateness is
    counted from the end of the row's hour."""
    spec = panes.PaneSpec(size_us=3 * panes.HOUR_US, slide_us=panes.HOUR_US)
    return panes.emissions(panes.pane_counts(panes.assign_ingest(table(spark, d, "ingest_event"), spec), ["index_name"], spec), ["index_name"], spec)


def _p1_window_emissions(spark, d):
    """Windows of three hours each hour, with every corrected emission; lateness is
    counted from the end of each window."""
    spec = panes.PaneSpec(size_us=3 * panes.HOUR_US, slide_us=panes.HOUR_US)
    return panes.window_emissions(panes.assign_ingest(table(spark, d, "ingest_event"), spec), ["index_name"], spec)


def _p1_segment_ranges(spark, d):
    return panes.segment_ranges(table(spark, d, "ingest_event"), table(spark, d, "segment_meta"))


def _p2_found(spark, d):
    return entries.found(table(spark, d, "wire_event"))


def _p2_entries(spark, d):
    """Every entry with its fields and whole message, the written time as an instant;
    rows that belong to no entry with their text as ``unparsed``."""
    wire = table(spark, d, "wire_event").withColumn("received_us", F.unix_micros(F.col("received_at").cast("timestamp")))
    whole = entries.records(wire, ["host", "received_us"])
    timed = instants.normalise_written_times(whole, table(spark, d, "asset"), "time_text", "host", "received_us")
    return timed.select("delivery_id", F.col("written_us").alias("event_us"), "lvl", "component", "message", "unparsed")


def kept_path(spark: SparkSession, name: str) -> str | None:
    """Where the session wants state ``name`` kept between runs (``tailrace.state.dir``), if it says so."""
    at = spark.conf.get("tailrace.state.dir", None)
    return f"{at.rstrip('/')}/{name}" if at else None


def _p4_found(spark, d):
    path = kept_path(spark, "times")
    dictionary = instants.TimeDictionary(spark, path) if path else None
    return instants.found(table(spark, d, "wire_event"), table(spark, d, "ingest_event"), table(spark, d, "asset"), dictionary)


def _p5_found(spark, d):
    return merkle.found(table(spark, d, "wal_entry"), table(spark, d, "notable"), table(spark, d, "run_log"), kept_path(spark, "feeds"))


def _p7_found(spark, d):
    return once.redundant(table(spark, d, "wire_event"))


def _p7_kept(spark, d):
    return once.exactly_once(table(spark, d, "wire_event").select("delivery_id", "id", "host", "batch_id")).select("delivery_id", "batch_id")


QUERIES: dict[str, Query] = {
    "p1_found": _p1_found,
    "p1_hourly_counts": _p1_hourly_counts,
    "p1_emissions": _p1_emissions,
    "p1_window_emissions": _p1_window_emissions,
    "p1_segment_ranges": _p1_segment_ranges,
    "p2_found": _p2_found,
    "p2_entries": _p2_entries,
    "p4_found": _p4_found,
    "p5_found": _p5_found,
    "p7_found": _p7_found,
    "p7_kept": _p7_kept,
}

_HOST = r"regexp_replace(lower(trim(host)), '\.$', '')"
_MICROS = """CASE WHEN timestamp_us < 100000000000 THEN timestamp_us * 1000000 WHEN timestamp_us < 100000000000000 THEN timestamp_us * 1000
  WHEN timestamp_us < 100000000000000000 THEN timestamp_us ELSE timestamp_us // 1000 END"""
_TIMED = f"""t AS (SELECT *, {_MICROS} AS us FROM ingest_event WHERE timestamp_us <> 0),
a AS (SELECT *, us - us % 3600000000 AS period_us, received_us - (us - us % 3600000000) - 3600000000 AS late FROM t)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_TIMED} SELECT ingest_id, period_us, CASE WHEN late < 43200000000 THEN 'corrects' ELSE 'dropped' END AS fate
FROM a WHERE late >= 600000000""",
    "p1_hourly_counts": f"""WITH {_TIMED} SELECT index_name, period_us, CAST(count(*) FILTER (coalesce(late, 0) < 600000000) AS BIGINT) AS n_first,
CAST(count(*) FILTER (late >= 600000000 AND late < 43200000000) AS BIGINT) AS n_corrected, CAST(count(*) FILTER (late >= 43200000000) AS BIGINT) AS n_dropped,
CAST(count(*) FILTER (coalesce(late, 0) < 43200000000) AS BIGINT) AS n FROM a GROUP BY 1, 2""",
    "p1_emissions": f"""WITH {_TIMED}, p AS (SELECT index_name, period_us, CASE WHEN coalesce(late, 0) < 600000000 THEN 0 ELSE late // 3600000000 + 1 END AS tick FROM a WHERE coalesce(late, 0) < 43200000000),
w AS (SELECT index_name, period_us - k * 3600000000 AS window_us, tick, count(*) AS n_added FROM p, (VALUES (0), (1), (2)) AS s(k) GROUP BY 1, 2, 3)
SELECT index_name, window_us, CAST(row_number() OVER o - 1 AS INTEGER) AS version, CAST(tick AS INTEGER) AS tick, CAST(n_added AS BIGINT) AS n_added, CAST(sum(n_added) OVER o AS BIGINT) AS n
FROM w WINDOW o AS (PARTITION BY index_name, window_us ORDER BY tick)""",
    "p1_window_emissions": f"""WITH {_TIMED}, s AS (SELECT index_name, received_us, period_us - k * 3600000000 AS window_us FROM a, (VALUES (0), (1), (2)) AS v(k)),
l AS (SELECT index_name, window_us, coalesce(received_us - window_us - 10800000000, 0) AS late FROM s),
w AS (SELECT index_name, window_us, CASE WHEN late < 600000000 THEN 0 ELSE late // 3600000000 + 1 END AS tick, count(*) AS n_added FROM l WHERE late < 43200000000 GROUP BY 1, 2, 3)
SELECT index_name, window_us, CAST(row_number() OVER o - 1 AS INTEGER) AS version, CAST(tick AS INTEGER) AS tick, CAST(n_added AS BIGINT) AS n_added, CAST(sum(n_added) OVER o AS BIGINT) AS n
FROM w WINDOW o AS (PARTITION BY index_name, window_us ORDER BY tick)""",
    "p1_segment_ranges": f"""WITH t AS (SELECT segment_id, CASE WHEN timestamp_us <> 0 THEN {_MICROS} END AS us FROM ingest_event),
r AS (SELECT segment_id, min(us) AS lo, max(us) AS hi, count(*) AS n FROM t GROUP BY 1)
SELECT s.segment_id, lo AS earliest_time, hi AS latest_time, CAST(coalesce(n, 0) AS BIGINT) AS event_count,
nullif(s.earliest_time, 0) IS NOT DISTINCT FROM lo AND nullif(s.latest_time, 0) IS NOT DISTINCT FROM hi AS agrees FROM segment_meta s LEFT JOIN r USING (segment_id)""",
    "p2_found": written_sql.ENTRIES_FOUND,
    "p2_entries": written_sql.ENTRIES,
    "p4_found": written_sql.REPAIRED,
    "p5_found": """WITH m AS (SELECT feed, max(to_mark) AS mark FROM run_log WHERE status = 'succeeded' AND committed_at IS NOT NULL GROUP BY 1)
SELECT DISTINCT w.wal_file AS feed, CAST(sequence_number AS VARCHAR) AS rec_key FROM wal_entry w LEFT JOIN m ON m.feed = w.wal_file
WHERE w.wal_file IS NOT NULL AND sequence_number IS NOT NULL AND (mark IS NULL OR sequence_number > mark)
UNION ALL SELECT DISTINCT 'notable', id FROM notable LEFT JOIN m ON m.feed = 'notable'
WHERE id IS NOT NULL AND (mark IS NULL OR epoch_us(created_at) > mark OR epoch_us(updated_at) > mark)""",
    "p7_found": f"""WITH k AS (SELECT delivery_id, row_number() OVER (PARTITION BY id, {_HOST} ORDER BY delivery_id) AS r FROM wire_event WHERE id <> '')
SELECT delivery_id FROM k WHERE r > 1""",
    "p7_kept": f"""WITH k AS (SELECT delivery_id, batch_id, CASE WHEN id <> '' THEN row_number() OVER (PARTITION BY id, {_HOST} ORDER BY delivery_id) ELSE 1 END AS r FROM wire_event)
SELECT delivery_id, batch_id FROM k WHERE r = 1""",
}
