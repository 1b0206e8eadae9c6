"""Problems 1, 2, 4, 5 and 7 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import time
import tracemalloc
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tailrace.functions.earley import ANY, Rule, WeightedEarley
from tailrace.functions.loglines import parse_line
from tailrace.io import Taken
from tailrace.operators import entries, instants, merkle, once, panes

HOUR = panes.HOUR_US
T0 = 1_710_000_000_000_000 // HOUR * HOUR
INGEST = "ingest_id long, received_us long, timestamp_us long, raw string, host string, index_name string, segment_id string, fate string"


# --- problem 1 ---------------------------------------------------------------


def ingest(spark, data):
    return spark.createDataFrame([(i, r, t, None, None, ix, seg, "own") for i, r, t, ix, seg in data], INGEST)


def test_p1_fates_at_the_bounds(spark, rows):
    end = T0 + HOUR
    data = [
        (1, end + 10 * panes.MINUTE_US - 1, T0, "a", "s"),
        (2, end + 10 * panes.MINUTE_US, T0 + HOUR - 1, "a", "s"),
        (3, end + 12 * HOUR - 1, T0, "a", "s"),
        (4, end + 12 * HOUR, T0, None, "s"),
        (5, end + 12 * HOUR, 0, "a", "s"),
        (6, end + 12 * HOUR, None, "a", None),
        (7, None, T0, "a", "s"),
        (8, end + 12 * HOUR, T0 // 1_000_000, "a", "s"),
        (9, end + HOUR, T0 // 1_000, "a", "s"),
        (10, end + HOUR, T0 * 1_000 + 999, "a", "s"),
    ]
    got = rows(panes.found(ingest(spark, data)))
    assert got == sorted([(2, T0, "corrects"), (3, T0, "corrects"), (4, T0, "dropped"), (8, T0, "dropped"), (9, T0, "corrects"), (10, T0, "corrects")], key=repr)
    spec = panes.PaneSpec()
    counts = rows(panes.final_counts(panes.assign_ingest(ingest(spark, data), spec), ["index_name"], spec))
    assert counts == sorted([("a", T0, 2, 4, 1, 6), (None, T0, 0, 0, 1, 0)], key=repr)


def test_p1_sliding_windows_are_sums_of_panes(spark, rows):
    spec = panes.PaneSpec(size_us=3 * HOUR, slide_us=2 * HOUR)
    assert spec.pane_us == HOUR
    times = [0, 1, 1, 4, 5, 5, 6, 9]
    data = [(k, T0 + (t + 1) * HOUR, T0 + t * HOUR + k, "a", "s") for k, t in enumerate(times)]
    got = rows(panes.windows_of(panes.pane_counts(panes.assign_ingest(ingest(spark, data), spec), [], spec), spec).groupBy("window_us").agg(F.sum("n")))
    expect = {}
    for k, t in enumerate(times):
        at = T0 + t * HOUR + k
        w = at // spec.slide_us * spec.slide_us
        while w + spec.size_us > at:
            expect[w] = expect.get(w, 0) + 1
            w -= spec.slide_us
    assert dict(got) == expect


def test_p1_emissions_count_up(spark, rows):
    spec = panes.PaneSpec()
    data = [(1, T0 + HOUR, T0, "a", "s"), (2, T0 + 2 * HOUR, T0, "a", "s"), (3, T0 + 2 * HOUR + 5, T0, "a", "s"), (4, T0 + 9 * HOUR, T0, "a", "s"), (5, T0 + 99 * HOUR, T0, "a", "s")]
    got = rows(panes.emissions(panes.pane_counts(panes.assign_ingest(ingest(spark, data), spec), ["index_name"], spec), ["index_name"], spec), "version", "tick", "n_added", "n")
    assert got == [(0, 0, 1, 1), (1, 2, 2, 3), (2, 9, 1, 4)]


def test_p1_lateness_counts_from_the_end_of_each_window(spark, rows):
    minute = panes.MINUTE_US
    spec = panes.PaneSpec(size_us=3 * HOUR, slide_us=2 * HOUR, grace_us=25 * minute, cutoff_us=5 * HOUR, tick_us=45 * minute)
    late = [None, -HOUR, 0, 25 * minute - 1, 25 * minute, 45 * minute, 3 * HOUR + 7, 5 * HOUR - 1, 5 * HOUR, 6 * HOUR + 24 * minute, 7 * HOUR - 1, 7 * HOUR, 99 * HOUR]
    data = [(k, None if x is None else T0 + (t + 1) * HOUR + x, T0 + t * HOUR + k, "a", "s") for t in range(4) for k, x in enumerate(late)]
    added = {}
    for _, received, event, *_ in data:
        w = event // spec.slide_us * spec.slide_us
        while w + spec.size_us > event:
            x = 0 if received is None else received - w - spec.size_us
            if x < spec.cutoff_us:
                key = (w, 0 if x < spec.grace_us else x // spec.tick_us + 1)
                added[key] = added.get(key, 0) + 1
            w -= spec.slide_us
    got = panes.window_emissions(panes.assign_ingest(ingest(spark, data), spec), ["index_name"], spec)
    assert {(r.window_us, r.tick): r.n_added for r in got.collect()} == added
    assert all(r.n == sum(n for (w, t), n in added.items() if w == r.window_us and t <= r.tick) for r in got.collect())
    # 12 h after the end of its hour, a row is still in time for the window that ends two hours later
    spec = panes.PaneSpec(size_us=3 * HOUR, slide_us=HOUR)
    got = rows(panes.window_emissions(panes.assign_ingest(ingest(spark, [(1, T0 + 13 * HOUR, T0, "a", "s")]), spec), [], spec))
    assert got == [(T0 - HOUR, 0, 12, 1, 1), (T0, 0, 11, 1, 1)]


def test_p1_segments_and_empty(spark, rows):
    seg = spark.createDataFrame([("s", T0, T0 + 5), ("t", 0, None), ("u", 1, 2)], "segment_id string, earliest_time long, latest_time long")
    data = [(1, T0, T0, "a", "s"), (2, T0, T0 + 5, "a", "s"), (3, T0, None, "a", "s")]
    assert rows(panes.segment_ranges(ingest(spark, data), seg)) == [("s", T0, T0 + 5, 3, True), ("t", None, None, 0, True), ("u", None, None, 0, False)]
    assert rows(panes.found(ingest(spark, []))) == []
    assert rows(panes.segment_ranges(ingest(spark, []), seg.limit(0))) == []


# --- problem 2 ---------------------------------------------------------------


def test_earley_keeps_the_best_parse_and_shares_prefixes():
    g = [Rule("s", ("a", "x"), 1.0, ((1, "whole"),)), Rule("s", ("a", ANY), 0.5, ((1, "rest"),)), Rule("s", ("list",), 0.1), Rule("list", ("a",)), Rule("list", ("a", "list")), Rule("x", ("b",), 0.2)]
    p = WeightedEarley(g, "s")
    assert p.parse("ab")[:2] == (1.2, 0)
    assert p.parse("abc")[1] == 1
    assert p.parse("aaa")[1] == 1
    size = p.size
    assert p.parse("aaa") and p.size == size
    assert p.parse("b") is None
    small = WeightedEarley(g, "s", max_nodes=3)
    assert [small.parse(t) and small.parse(t)[1] for t in ("ab", "abc", "aab", "ab")] == [0, 1, 1, 0]


@pytest.mark.parametrize(
    "raw, time, level, component",
    [
        ("<62>Mar 28 13:38:22 idx-pivot-21 webtier[18922]: x", "Mar 28 13:38:22", "INFO", "webtier"),
        ("<8>Apr  2 14:59:11 h a: b", "Apr  2 14:59:11", "FATAL", "a"),
        ("<39>Apr  2 14:59:11 h a", "Apr  2 14:59:11", "DEBUG", ""),
        ("<53>1 2024-03-12T10:03:54.433638Z h quotad 5127 MK55 - t", "2024-03-12T10:03:54.433638Z", "INFO", "quotad"),
        ("<12>1 2024-03-12T10:03:54.433+01:00 h - - - - t", "2024-03-12T10:03:54.433+01:00", "WARN", ""),
        ("2024-04-06 07:04:55,059 [w-27] CRIT  net.kelvo.store.Flush - m", "2024-04-06 07:04:55,059", "FATAL", "net.kelvo.store.Flush"),
        ("E0404 03:35:05.457337 20819 wal_tail.cc:425] m", "E0404 03:35:05.457337", "ERROR", "wal_tail.cc"),
        ('10.1.1.1 - u [06/Apr/2024:17:42:06 +0000] "GET / HTTP/1.1" 204 1 "-" "-"', "06/Apr/2024:17:42:06 +0000", "", ""),
        ('time=2024-03-13T15:08:32Z level=Info app=feedpull msg="a b"', "2024-03-13T15:08:32Z", "INFO", "feedpull"),
        ('level=ERR ts="2024-03-17 12:11:25.761463" msg="a"', "2024-03-17 12:11:25.761463", "ERROR", ""),
        ('msg="no time" level=ERR', None, "", ""),
        ("1710152908.378|WARNING|indexd|m", "1710152908.378", "WARN", "indexd"),
        ("1710608416962|authsvc|notice|m", "1710608416962", "INFO", "authsvc"),
        ("WARN     2024-03-31 08:27:23.926856 +0900 tapfilter: m", "2024-03-31 08:27:23.926856 +0900", "WARN", "tapfilter"),
        ("emerg 2024-03-31 15:09:10 CEST spoolagent: m", "2024-03-31 15:09:10 CEST", "FATAL", "spoolagent"),
        ("[2024-03-23T21:18:22+05:30] [dbg] [flushd] m", "2024-03-23T21:18:22+05:30", "DEBUG", "flushd"),
        ("[2024-03-10T16:43:54+01:00] [indexd] [panic] m", "2024-03-10T16:43:54+01:00", "FATAL", "indexd"),
        ("03/30/2024 5:26:25 PM Level=Info Source=indexd\nMessage=m", "03/30/2024 5:26:25 PM", "INFO", "indexd"),
        ("03/22/2024 11:03:59 AM\r\nLevel=Err\r\nSource=shipper\r\nMessage=m", "03/22/2024 11:03:59 AM", "ERROR", "shipper"),
        ("28.3.2024 12:50:41,621 <TRACE> dnsrelay: m", "28.3.2024 12:50:41,621", "DEBUG", "dnsrelay"),
        ("09.03.2024 07:52:05;vaultkeep;INFO;m", "09.03.2024 07:52:05", "INFO", "vaultkeep"),
        ('{"message":"f","svc":"edge-gate","time":"2024-04-03T04:39:33.131691418+00:00"}', "2024-04-03T04:39:33.131691418+00:00", "", "edge-gate"),
        ('{"ts":1710084447.086657,"log":{"level":"E","logger":"a"},"msg":"c"}', "1710084447.086657", "ERROR", "a"),
        ('{"x": [{"y": [1, []]}, {"z": null}], "ts":"2024-04-03T04:39:33Z", "lvl":"warn"}', "2024-04-03T04:39:33Z", "WARN", ""),
        ('{"n": 5, "x": [1, "a"], "ts":"2024-04-03T04:39:33Z", "lvl":"odd"}', "2024-04-03T04:39:33Z", "", ""),
        ("\tat net.kelvo.store.Flush.write(Flush.java:474)", None, "", ""),
        ("Traceback (most recent call last):", None, "", ""),
        ("  key=50", None, "", ""),
    ],
)
def test_p2_header_layouts(raw, time, level, component):
    p = parse_line(raw)
    assert (p.time, p.level, p.component) == (time, level, component)
    assert (p.unparsed is None) == (time is not None)


@pytest.mark.parametrize(
    "raw, level, component, message, unparsed",
    [
        ("ts=2024-03-13T15:08:32Z level=warn app=feedpull msg=late took=(3ms) n=1", "WARN", "feedpull", "late took=(3ms) n=1", None),
        ('ts=2024-03-13T15:08:32Z level=warn msg="late" took=(3ms) n=1', "WARN", "", "late", "took=(3ms) n=1"),
        ("time=2024-03-13T15:08:32Z level=info app=x path=/a?b=c", "INFO", "x", None, "=c"),
        ('ts=2024-03-13T15:08:32Z level=err msg="m" empty= more', "ERROR", "", "m", None),
        ('ts=2024-03-13T15:08:32Z level=err msg="m" my-key=4', "ERROR", "", "m", "my-key=4"),
        ('ts=2024-03-13T15:08:32Z level=err msg="m"\nTraceback (most recent call last):', "ERROR", "", "m", "Traceback (most recent call last):"),
        ('{"ts":"2024-03-13T15:08:32Z","level":"warn","svc":"a","msg":"m","cut":"of', "WARN", "a", "m", ',"cut":"of'),
        ('{"ts":"2024-03-13T15:08:32Z","level":"warn","msg":"m"} and more', "WARN", "", "m", "and more"),
    ],
)
def test_p2_time_survives_an_odd_tail(raw, level, component, message, unparsed):
    p = parse_line(raw)
    assert p.time == "2024-03-13T15:08:32Z"
    assert (p.level, p.component, p.message, p.unparsed) == (level, component, message, unparsed)


def test_p2_blank_and_odd_lines():
    assert parse_line(None) is None and parse_line(" \n") is None
    for raw in ("\x00", "{" * 500, '"', "a" * 100_000, "=" * 300, "[" + "x [" * 200):
        assert parse_line(raw).time is None


WIRE = "delivery_id long, batch_id long, batch_pos int, received_at timestamp, id string, event_time struct<seconds:bigint,microseconds:int>, raw string, host string, source string, sourcetype string, index_name string, fields map<string,string>, lvl string, entry long"
A = "2024-04-06 07:04:55,059 [w-27] INFO  net.Flush - m"


def wire(spark, data):
    at = datetime(2024, 4, 7, 12)
    full = [(i, b, p, at, mid, t, raw, h, s, None, "main", f, "own", 1) for i, b, p, mid, t, raw, h, s, f in data]
    return spark.createDataFrame(full, WIRE)


P2 = [
    (1, 1, 0, None, None, " more of nothing", "h", "s", None),
    (2, 1, 1, None, None, A, "h", "s", None),
    (3, 1, 2, None, None, "other host", "g", "s", None),
    (4, 1, 3, None, None, "more", " H. ", "s", None),
    (5, 1, 4, None, None, " ", "h", "s", None),
    (6, 1, 5, None, None, None, "h", "s", None),
    (7, 1, 6, None, None, "more", "h", None, None),
    (8, 1, 7, None, None, "still more", "h", "s", {}),
    (9, 1, 8, None, None, A.replace("INFO", "x"), "h", "s", {"a": "b"}),
    (10, 1, 9, None, None, "of the one with fields", "h", "s", None),
    (11, 2, 0, None, None, "other batch", "h", "s", None),
    (12, 2, 1, None, None, A, None, None, None),
    (13, 2, 2, None, None, "null equals null", None, None, None),
]


@pytest.mark.parametrize("block", [entries.BLOCK, 2, 1])
def test_p2_entries_by_batch_host_and_source(spark, rows, monkeypatch, block):
    monkeypatch.setattr(entries, "BLOCK", block)
    got = rows(entries.found(wire(spark, P2)))
    assert got == [(12, 13, "INFO", "net.Flush"), (2, 8, "INFO", "net.Flush")]


@pytest.mark.parametrize("block", [entries.BLOCK, 2, 1])
def test_p2_records_hold_all_text(spark, rows, monkeypatch, block):
    monkeypatch.setattr(entries, "BLOCK", block)
    got = rows(entries.records(wire(spark, P2), ["host"]), "delivery_id", "last_delivery_id", "host", "lvl", "message", "unparsed")
    expect = [
        (1, 1, None, None, None, " more of nothing"),
        (2, 8, "h", "INFO", "m\nmore\nstill more", None),
        (3, 3, None, None, None, "other host"),
        (7, 7, None, None, None, "more"),
        (9, 10, "h", "", "[w-27] x  net.Flush - m\nof the one with fields", None),
        (11, 11, None, None, None, "other batch"),
        (12, 13, None, "INFO", "m\nnull equals null", None),
    ]
    assert got == sorted(expect, key=repr)
    assert rows(entries.records(wire(spark, []))) == []


def test_p2_rows_without_a_place_stand_alone(spark, rows):
    data = [(1, None, 0, None, None, A, "h", "s", None), (2, None, 1, None, None, "x", "h", "s", None), (3, 1, None, None, None, "y", "h", "s", None), (4, 1, 0, None, None, A, "h", "s", None), (5, 1, None, None, None, "z", "h", "s", None)]
    assert rows(entries.found(wire(spark, data))) == [(1, 1, "INFO", "net.Flush"), (4, 4, "INFO", "net.Flush")]
    assert rows(entries.records(wire(spark, data)), "delivery_id", "last_delivery_id", "unparsed") == [(1, 1, None), (2, 2, "x"), (3, 3, "y"), (4, 4, None), (5, 5, "z")]


@pytest.mark.parametrize("line", ['{"ts":"2024-03-12T10:03:54Z",%s,"level":"error"}', "ts=2024-03-12T10:03:54Z %s level=error"])
def test_p2_long_lines_take_linear_time_and_little_memory(line):
    pair, between = ('"key%d":"some value"', ",") if line[0] == "{" else ("key%d=value", " ")
    text = line % between.join(pair % k for k in range(4500))
    assert len(text) > 50_000 and parse_line("2024-03-12T10:03:54Z x") is not None
    began = time.process_time()
    p = parse_line(text)
    assert time.process_time() - began < 3 and (p.time, p.level) == ("2024-03-12T10:03:54Z", "ERROR")
    tracemalloc.start()
    parse_line(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_p2_the_trie_is_bounded():
    earley = WeightedEarley([Rule("s", ("items",)), Rule("items", ("a",)), Rule("items", ("b",)), Rule("items", ("items", "a")), Rule("items", ("items", "b"), 1.0)], "s", max_nodes=50, keep_depth=8)
    for k in range(300):
        bits = [("a", "b")[k >> j & 1] for j in range(12)]
        assert earley.parse(bits)[0] == sum(t == "b" for t in bits[1:]) and earley.size <= 50 + 9


def test_p2_empty_and_full_parse(spark, rows):
    assert rows(entries.found(wire(spark, []))) == []
    got = rows(entries.parse_lines(wire(spark, P2[:3]), "raw", ["delivery_id"]), "delivery_id", "begins", "message", "unparsed")
    assert got == [(1, False, None, " more of nothing"), (2, True, "m", None), (3, False, None, "other host")]


# --- problem 4 ---------------------------------------------------------------


def us(*a, **k):
    d = datetime(*a, tzinfo=timezone.utc, **k)
    return int((d - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


P4 = [
    ("2024-03-12T10:03:54.433638Z x", "UTC", us(2024, 3, 12, 10, 3, 54, 433638)),
    ("[2024-03-10T16:43:54+0530] x", "UTC", us(2024, 3, 10, 11, 13, 54)),
    ('{"t":"2024-03-10T16:43:54.123456789-04:00"}', "UTC", us(2024, 3, 10, 20, 43, 54, 123456)),
    ("2024-03-31 15:09:10 CEST x", "UTC", us(2024, 3, 31, 13, 9, 10)),
    ("2024-03-31 15:09:10.5 AEDT x", "UTC", us(2024, 3, 31, 4, 9, 10, 500000)),
    ("2024-04-06 07:04:55,059 x", "Asia/Kolkata", us(2024, 4, 6, 1, 34, 55, 59000)),
    ("2024-04-07 02:30:00 x", "Australia/Sydney", us(2024, 4, 6, 15, 30)),
    ("2024-04-07 03:30:00 x", "Australia/Sydney", us(2024, 4, 6, 17, 30)),
    ("2024-03-31 03:30:00 x", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
    ("03/30/2024 12:26:25 AM x", "UTC", us(2024, 3, 30, 0, 26, 25)),
    ("03/30/2024 12:26:25 PM x", "UTC", us(2024, 3, 30, 12, 26, 25)),
    ("9.3.2024 11:28:43,789 x", "Europe/Berlin", us(2024, 3, 9, 10, 28, 43, 789000)),
    ('1.1.1.1 - - [06/Apr/2024:17:42:06 -0500] "', "UTC", us(2024, 4, 6, 22, 42, 6)),
    ("<1>Apr  2 14:59:11 x", "America/New_York", us(2024, 4, 2, 18, 59, 11)),
    ("<1>Dec 31 23:59:59 x", "UTC", us(2023, 12, 31, 23, 59, 59)),
    ("I0404 03:35:05.457337 7 x", "UTC", us(2024, 4, 4, 3, 35, 5, 457337)),
    ("1710152908.378|a", "UTC", us(2024, 3, 11, 10, 28, 28, 378000)),
    ('{"when":1710152908378,"m":1}', "UTC", us(2024, 3, 11, 10, 28, 28, 378000)),
    ("ts=1710152908 x", "UTC", us(2024, 3, 11, 10, 28, 28)),
    ("nothing 12345", "UTC", None),
    ("2024-13-45 99:99:99 x", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
]


def test_p4_written_times(spark):
    at = us(2024, 4, 7)
    df = spark.createDataFrame([(k, raw, f"h-{z}", at) for k, (raw, z, _) in enumerate(P4)], "k int, raw string, host string, received_us long")
    assets = spark.createDataFrame([(f"H-{z}.", z) for z in {z for _, z, _ in P4}] + [(None, "Asia/Tokyo"), ("x", None)], "hostname string, time_zone string")
    got = {r.k: r.written_us for r in instants.normalise_written_times(df, assets, "raw", "host", "received_us").collect()}
    assert {k: got[k] for k in got if got[k] != P4[k][2]} == {}
    assert len(got) == len(P4)


def test_p4_numbers_and_missing(spark, rows):
    A2 = "2024-04-06 07:04:55,059 x"
    w = wire(spark, [
        (1, 1, 0, None, (1710152908, 5), "x", "h", None, None),
        (2, 1, 0, None, (1710152908378, 0), "x", "h", None, None),
        (3, 1, 0, None, (1710152908378123, 0), "x", "h", None, None),
        (4, 1, 0, None, (1710152908378123456, 0), "x", "h", None, None),
        (5, 1, 0, None, (1710152908, 998813602), "x", "h", None, None),
        (6, 1, 0, None, (0, 7), A2, "h", None, None),
        (7, 1, 0, None, None, A2, None, None, None),
        (8, 1, 0, None, None, "no time", None, None, None),
        (9, 1, 0, None, (None, None), None, None, None, None),
        (10, 1, 0, None, (1710152908, None), "x", "h", None, None),
    ])
    i = spark.createDataFrame([(1, 0, us(2024, 4, 7), A2, "h"), (2, None, us(2024, 4, 7), None, None), (3, 1710152908, None, A2, "h"), (4, us(2024, 4, 7), 1, A2, "h"), (5, us(2024, 4, 7) * 1000 + 1, 1, A2, "h")], "ingest_id long, timestamp_us long, received_us long, raw string, host string")
    assets = spark.createDataFrame([], "hostname string, time_zone string")
    sec, t = 1710152908_000_000, us(2024, 4, 6, 7, 4, 55, 59000)
    got = rows(instants.found(w, i, assets))
    assert got == sorted([("wire_event", 2, sec + 378000), ("wire_event", 3, sec + 378123), ("wire_event", 4, sec + 378123), ("wire_event", 5, sec + 998813), ("wire_event", 6, t), ("wire_event", 7, t),
                          ("ingest_event", 1, t), ("ingest_event", 3, sec), ("ingest_event", 5, us(2024, 4, 7))], key=repr)
    assert rows(instants.found(wire(spark, []), i.limit(0), assets)) == []


def test_p4_dictionary_grows_by_what_is_new(spark, tmp_path, monkeypatch):
    d = instants.TimeDictionary(spark, str(tmp_path / "d"))
    keys = lambda *t: spark.createDataFrame([(x, "UTC", 2024) for x in t], "time_text string, zone string, receipt_year int")
    assert d.update(keys("2024-01-01 00:00:00", "2024-01-01 00:00:00", None)).count() == 1
    assert d.update(keys("2024-01-01 00:00:00", "2024-01-02 00:00:00")).count() == 2
    assert d.update(keys("2024-01-01 00:00:00")).count() == 2
    # a writer that comes second finds the keys of the first and adds no second row
    f, g = instants.TimeDictionary(spark, str(tmp_path / "f")), instants.TimeDictionary(spark, str(tmp_path / "f"))
    g_missing, g.missing = g.missing, lambda k: (f.update(keys("2024-01-01 00:00:00")), k.select(*instants.KEY).distinct())[1] if not f.parts() else g_missing(k)
    assert g.update(keys("2024-01-01 00:00:00", "2024-01-02 00:00:00")).count() == 2 and f.read().count() == 2 and len(f.parts()) == 2
    # the folders are written into one from time to time
    monkeypatch.setattr(instants, "MOST_PARTS", 3)
    for day in (3, 4, 5):
        f.update(keys(f"2024-01-{day:02d} 00:00:00"))
    assert len(f.parts()) == 2 and f.read().count() == f.read().select(*instants.KEY).distinct().count() == 5
    assert f.missing(keys("2024-01-04 00:00:00", "2024-02-01 00:00:00")).count() == 1
    # two states of the table in one plan stay two
    e = instants.TimeDictionary(spark, str(tmp_path / "e"))
    older, newer = e.update(keys("2024-01-01 00:00:00")), e.update(keys("2024-01-03 00:00:00"))
    assert older.join(newer, "time_text").count() == 1 and newer.join(older, "time_text").count() == 1
    assert older.groupBy("time_text").count().unionByName(newer.groupBy("time_text").count()).count() == 3


def test_p4_a_second_run_parses_nothing(spark, rows, tmp_path):
    w = wire(spark, [(k, 1, 0, None, None, f"2024-04-06 07:04:5{k % 3},059 x", "h", None, None) for k in range(9)])
    i = spark.createDataFrame([(1, 0, us(2024, 4, 7), "2024-04-06 07:04:50,059 y", "g")], "ingest_id long, timestamp_us long, received_us long, raw string, host string")
    assets, d = spark.createDataFrame([], "hostname string, time_zone string"), instants.TimeDictionary(spark, str(tmp_path / "d"))
    first = rows(instants.found(w, i, assets, d))
    parts = d.parts()
    assert len(first) == 10 and len(parts) == 1 and d.read().count() == 3  # the ingest row states a time that wire rows state too
    assert rows(instants.found(w, i, assets, d)) == first and d.parts() == parts
    assert rows(instants.found(w, i, assets)) == first


# --- problem 5 ---------------------------------------------------------------


def test_p5_due_records(spark, rows):
    wal = spark.createDataFrame([("w1", n) for n in (*range(1, 300), 299, 250)] + [("w2", 1), ("w2", 1), ("w3", 5), (None, 9), ("w1", None)], "wal_file string, sequence_number long")
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    notable = spark.createDataFrame([("a", at(1), None), ("a", at(1), at(50)), ("b", at(1), at(2)), ("c", at(99), None), ("c", at(99), None), (None, at(99), None), ("d", None, None), ("e", at(10), at(10))], "id string, created_at timestamp, updated_at timestamp")
    mark = us(2024, 1, 1) + 10_000_000
    log = spark.createDataFrame([("w1", "succeeded", at(1), 200), ("w1", "succeeded", at(2), 296), ("w1", "failed", at(3), 299), ("w1", "succeeded", None, 300), ("w3", "failed", at(1), 9), ("notable", "succeeded", at(1), mark), (None, "succeeded", at(1), 9)], "feed string, status string, committed_at timestamp, to_mark long")
    assert rows(merkle.found(wal, notable, log)) == sorted([("w1", "297"), ("w1", "298"), ("w1", "299"), ("w2", "1"), ("w3", "5"), ("notable", "a"), ("notable", "c")], key=repr)
    everything = rows(merkle.found(wal, notable, log.limit(0)))
    assert len(everything) == 299 + 2 + 5
    assert rows(merkle.found(wal.limit(0), notable.limit(0), log)) == []


def test_p5_tree_finds_changed_leaves_only(spark, rows):
    df = spark.range(5000).select(F.lit("f").alias("feed"), F.col("id").cast("string").alias("rec_key"), merkle.number_leaf(F.col("id")).alias("leaf"), F.xxhash64("id").alias("digest"))
    was = merkle.leaves(df)
    now = df.withColumn("digest", F.when(F.col("rec_key") == "130", F.lit(7).cast("long")).otherwise(F.col("digest"))).filter("rec_key <> '4990'")
    assert rows(merkle.changed_leaves(merkle.leaves(now), was)) == [("f", 2), ("f", 77)]
    assert rows(merkle.changed_leaves(was, was)) == []


def merkle_table(spark, values):
    df = spark.createDataFrame(list(values.items()), "k long, v string")
    return merkle.records(df, F.lit("f"), F.col("k"), merkle.number_leaf(F.col("k")), [F.col("v")])


def test_p5_a_row_that_arrives_during_a_run_belongs_to_the_next(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "src")
    merkle_table(spark, {1: "a", 2: "a"}).write.parquet(src)
    source = lambda: spark.read.parquet(src)
    state = merkle.MerkleState(spark, str(tmp_path / "m"))
    keys = lambda df: sorted(int(r.rec_key) for r in df.collect())

    def late(due):
        merkle_table(spark, {3: "a"}).write.mode("append").parquet(src)
        spark.catalog.refreshByPath(src)
        return due

    assert keys(state.run(source(), publish=late)) == [1, 2]
    assert keys(state.run(source())) == [3]
    assert keys(state.run(source())) == []


def test_p5_two_writers_and_deletions(spark, tmp_path, monkeypatch):
    keys = lambda df: sorted(int(r.rec_key) for r in df.collect())
    one, two = (merkle.MerkleState(spark, str(tmp_path / "m")) for _ in range(2))
    one.run(merkle_table(spark, {k: "a" for k in range(200)}))
    values = {k: "a" for k in range(200) if k not in (2, 150)} | {7: "b"}

    def meanwhile(due):
        two.run(merkle_table(spark, values))
        return due

    with pytest.raises(Taken):
        one.run(merkle_table(spark, values), publish=meanwhile)
    assert one.version()[0] == 2 and keys(one.output()) == [7] and keys(one.removed()) == [2, 150]
    assert one.vacuum() == 1
    # records are kept by the version that changed their leaf, and together again after some versions
    monkeypatch.setattr(merkle, "MOST_HOMES", 2)
    for n in range(2):
        values[7] = f"c{n}"
        assert keys(one.run(merkle_table(spark, values))) == [7] and keys(one.removed()) == []
    assert len(one.commits.last()[1]["homes"]) <= 2
    assert keys(one.run(merkle_table(spark, {}))) == [] and len(keys(one.removed())) == 198
    assert keys(one.run(merkle_table(spark, {5: "a"}))) == [5]


def test_p5_seed_and_a_kept_state(spark, tmp_path, rows):
    schema = ("wal_file string, sequence_number long", "id string, created_at timestamp, updated_at timestamp", "feed string, status string, committed_at timestamp, to_mark long")
    wal = lambda top: spark.createDataFrame([("w1", n) for n in range(top)], schema[0])
    notable, log = spark.createDataFrame([], schema[1]), spark.createDataFrame([("w1", "succeeded", datetime(2024, 1, 1), 99)], schema[2])
    path = str(tmp_path / "feeds")
    assert rows(merkle.found(wal(103), notable, log, path)) == [("w1", "100"), ("w1", "101"), ("w1", "102")]
    assert rows(merkle.found(wal(104), notable, log, path)) == [("w1", "103")]
    state = merkle.MerkleState(spark, path)
    assert state.version()[0] == 3
    with pytest.raises(ValueError):
        state.seed(merkle_table(spark, {1: "a"}))


def test_p5_runs_publish_output_and_tree_together(spark, tmp_path):
    table = lambda values: merkle_table(spark, values)
    state = merkle.MerkleState(spark, str(tmp_path / "m"))
    keys = lambda df: sorted(int(r.rec_key) for r in df.collect())
    values = {k: "a" for k in range(200)}
    assert keys(state.run(table(values))) == list(range(200))
    assert keys(state.run(table(values))) == []
    values |= {5: "b", 500: "a"}

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        state.run(table(values), publish=fails)
    assert state.version()[0] == 2
    assert keys(state.run(table(values))) == [5, 500]
    assert keys(state.run(table(values))) == []


# --- problem 7 ---------------------------------------------------------------


@pytest.mark.parametrize("hot", [once.HOT_COPIES, 3])
def test_p7_one_copy_is_kept(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(once, "HOT_COPIES", hot)
    data = [(1, "a", "h"), (2, "a", " H."), (3, "a", None), (4, "a", "g"), (5, "b", "h"), (6, "b", "h"), (7, "b", "H"), (8, "b", "h"), (9, None, "h"), (10, None, "h"), (11, "", "h"), (12, "", "h"), (13, "c", None), (14, "c", None), (15, "c", "")]
    df = spark.createDataFrame([(*r, "first", 1) for r in data], "delivery_id long, id string, host string, first string, copies long")
    keyed = once._keyed(df, "delivery_id", "id", "host")
    got = rows(once.ranked_copies(keyed, once.frequencies(keyed), hot).filter("not is_first").select("seq"))
    assert got == [(14,), (2,), (6,), (7,), (8,)]
    assert sorted(r[0] for r in once.exactly_once(df).select("delivery_id").collect()) == [1, 3, 4, 5, 9, 10, 11, 12, 13, 15]
    assert rows(once.redundant(df.limit(0))) == []


def test_p7_new_messages_against_stored(spark):
    schema = "delivery_id long, id string, host string"
    stored = spark.createDataFrame([(1, "a", "h"), (2, None, "h")], schema)
    arrived = spark.createDataFrame([(3, "a", "H "), (4, "b", "h"), (5, "b", "h"), (6, None, "h"), (7, "a", None)], schema)
    assert sorted(r[0] for r in once.new_messages(stored, arrived).select("delivery_id").collect()) == [4, 6, 7]
