"""A stream gives what a batch gives."""

from datetime import datetime

from pyspark.sql import functions as F

from tailrace.operators import panes
from tailrace.sources.files import tail_logs
from tailrace.sources.normalise import INPUT, batch, normalise
from tailrace.sources.store import EventStore
from tailrace.streaming.ingest import without_repeats, write_events
from tailrace.streaming.panes import PaneStore, start, watermarked_counts

HOUR = panes.HOUR_US
T0 = 1_710_000_000_000_000 // HOUR * HOUR
SCHEMA = "ingest_id long, received_us long, timestamp_us long, index_name string"


def test_stream_into_the_store(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "a.log").write_text("2024-01-01T00:00:00Z one\n\n2024-01-02T00:00:00Z two\n")
    write_events(tail_logs(spark, str(src)), out, str(tmp_path / "cp"), once=True).awaitTermination()
    (src / "b.log").write_text("2024-01-02T00:00:01Z three\n")
    write_events(tail_logs(spark, str(src)), out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = EventStore(spark, out).read("main").orderBy("_time").collect()
    assert [(r._raw[-3:], r._time) for r in got] == [("one", datetime(2024, 1, 1)), ("two", datetime(2024, 1, 2)), ("ree", datetime(2024, 1, 2, 0, 0, 1))]


def test_stream_and_batches_share_a_store(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "a.log").write_text("2024-01-01T00:00:00Z one\n")
    write_events(tail_logs(spark, str(src)), out, str(tmp_path / "cp"), once=True).awaitTermination()
    store = EventStore(spark, out)
    store.append(normalise(batch(spark, [{"raw": "2024-01-01T00:00:01Z two"}])))
    (src / "b.log").write_text("2024-01-01T00:00:02Z three\n")
    write_events(tail_logs(spark, str(src)), out, str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.read().count() == 3 and len(store.compact()) == 1 and store.read("main").count() == 3


def test_panes_over_a_stream_equal_the_batch(spark, tmp_path, rows):
    spec = panes.PaneSpec(size_us=2 * HOUR, slide_us=HOUR)
    data = [(k, T0 + (k % 7 + k % 3 * 6) * HOUR, T0 + k % 7 * HOUR + k, "a" if k % 2 else "b") for k in range(60)]
    src = str(tmp_path / "in")
    received, event = F.col("received_us"), F.col("timestamp_us")
    for part in range(3):
        spark.createDataFrame(data[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        start(stream, event, received, ["index_name"], spec, str(tmp_path / "state"), str(tmp_path / "cp"), once=True).awaitTermination()
    store = PaneStore(spark, str(tmp_path / "state"), {"index_name": "string"}, spec)
    whole = panes.assign(spark.createDataFrame(data, SCHEMA), event, received, spec)
    expect = panes.windows_of(panes.pane_counts(whole, ["index_name"], spec).filter("tick >= 0"), spec).groupBy("index_name", "window_us").agg(F.sum("n").alias("n"))
    assert rows(store.current()) == rows(expect)
    # a batch given again after a failure overwrites itself
    before = rows(store.current())
    store.take(panes.assign(spark.createDataFrame(data[40:], SCHEMA), event, received, spec), 2)
    assert rows(store.current()) == before


def test_windows_wait_for_the_clock_and_batches_are_added_up(spark, tmp_path, rows):
    spec = panes.PaneSpec()
    store = PaneStore(spark, str(tmp_path / "state"), {"index_name": "string"}, spec, most_batches=2)
    take = lambda n, event, received: store.take(panes.assign(spark.createDataFrame([(n, received, event, None)], SCHEMA), F.col("timestamp_us"), F.col("received_us"), spec), n)
    take(0, T0, T0 + 1)
    assert rows(store.current()) == []
    take(1, T0 + HOUR, T0 + HOUR + 9 * panes.MINUTE_US)
    assert rows(store.current()) == []  # the grace of the first hour isn't over
    take(2, T0 + 40 * HOUR, T0 + HOUR + 10 * panes.MINUTE_US)
    assert rows(store.current()) == [(None, T0, 1)]
    take(3, T0 + 1, T0 + 3 * HOUR)  # corrects the first hour; the second is due
    assert rows(store.current()) == [(None, T0, 2), (None, T0 + HOUR, 1)]
    take(4, T0 + 2, T0 + 14 * HOUR)  # too late
    assert rows(store.current()) == [(None, T0, 2), (None, T0 + HOUR, 1)]
    assert store.commits.last()[0] >= 1 and len(store._folders("panes")) <= 4
    store.flush()
    assert rows(store.current()) == [(None, T0, 2), (None, T0 + HOUR, 1), (None, T0 + 40 * HOUR, 1)]


def test_stream_keeps_late_rows_for_windows_inside_their_cutoff(spark, tmp_path, rows):
    spec = panes.PaneSpec(size_us=3 * HOUR, slide_us=HOUR)
    store = PaneStore(spark, str(tmp_path / "state"), {"index_name": "string"}, spec)
    for batch, late in enumerate((0, 12, 13, 14)):
        df = spark.createDataFrame([(batch, T0 + (1 + late) * HOUR, T0, "a")], SCHEMA)
        store.take(panes.assign(df, F.col("timestamp_us"), F.col("received_us"), spec), batch)
    assert rows(store.current()) == [("a", T0 - 2 * HOUR, 1), ("a", T0 - HOUR, 2), ("a", T0, 3)]


def test_watermarked_counts_and_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t.replace(hour=5), "a")], "id long, t timestamp, k string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, t timestamp, k string").parquet(src)
    q = watermarked_counts(stream, "t", ["k"])
    run = q.writeStream.format("memory").queryName("wc").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.n for r in spark.table("wc").collect()) == [1, 2]
    run = without_repeats(stream, "t", ["id"]).writeStream.format("memory").queryName("wr").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("wr").count() == 2


def test_input_schema_is_what_streams_take(spark):
    assert spark.createDataFrame([], INPUT).columns == ["raw", "host", "source", "sourcetype", "index", "timestamp_us"]


def test_rules_over_a_stream(spark, tmp_path):
    from tailrace.detect.rules import BUILTIN
    from tailrace.streaming.detect import watch
    from tests.events import SAMPLE

    src, got = str(tmp_path / "in"), []
    data = [(h, r) for _, h, raws in SAMPLE for r in raws]
    spark.createDataFrame(data, "host string, _raw string").write.parquet(src)
    stream = spark.readStream.schema("host string, _raw string").parquet(src)
    watch(stream, BUILTIN, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sum(r.n for r in got if r.rule_id == "BF-001") == 6 and {r.rule_id for r in got} == {r.id for r in BUILTIN}
