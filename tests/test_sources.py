import logging
import socket
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tailrace.functions.syslog import event_time, syslog_fields
from tailrace.functions.text import bytes_text
from tailrace.sources import files, sockets
from tailrace.sources.lines import break_lines, sourcetype_of
from tailrace.sources.normalise import batch, from_syslog, normalise
from tailrace.sources.store import EventStore
from tailrace.streaming.ingest import write_events


@pytest.mark.parametrize(
    "line, sender, host, source, sourcetype",
    [
        ("<34>1 2024-01-15T10:30:00.123+02:00 hostA app1 77 ID1 - msg", None, "hostA", "app1", "syslog:auth"),
        ("<13>Jan  5 10:30:00 hostB sshd[9]: Failed", None, "hostB", "sshd", "syslog:user"),
        ("Jan 15 10:30:00 web-server-01 sudo: x", None, "web-server-01", "sudo", "syslog"),
        ("<34>1 - - - - - - m", "10.0.0.7", "10.0.0.7", "syslog", "syslog:auth"),
        ("<34>1 - - - - - - m", None, "unknown", "syslog", "syslog:auth"),
        ("<191>Jan 15 10:30:00 - x: y", None, "unknown", "x", "syslog:local7"),
        ("no syslog at all", None, "unknown", "syslog", "syslog"),
        ("<999>Jan 15 10:30:00 h x: y", None, "h", "x", "syslog"),
    ],
)
def test_syslog_envelopes(spark, line, sender, host, source, sourcetype):
    f = syslog_fields(F.col("l"), F.col("s"))
    r = spark.createDataFrame([(line, sender)], "l string, s string").select(*[f[k].alias(k) for k in ("host", "source", "sourcetype")]).first()
    assert tuple(r) == (host, source, sourcetype)


def test_event_time_of_raw_lines(spark):
    lines = [
        ("2024-01-15T10:30:00Z something", datetime(2024, 1, 15, 10, 30)),
        ("event at 1705312200.123 on server", datetime(2024, 1, 15, 9, 50, 0, 123000)),
        ("Jan 15 10:30:00 server01 sshd[1234]: x", datetime(2024, 1, 15, 10, 30)),
        ("just a plain message without time", None),
        (None, None),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(lines)], "k int, r string").select("k", event_time(F.col("r"), F.lit(datetime(2024, 2, 1)).cast("timestamp")).alias("t"))
    assert {r.k: r.t for r in df.collect()} == {k: t for k, (_, t) in enumerate(lines)}


def test_line_breaking(spark):
    def raws(data, **k):
        return [r.raw for r in break_lines(spark.createDataFrame([(data,)], "value string"), **k).orderBy("event_no").collect()]

    assert raws("a\n\nb\r\nc", mode="single") == ["a", "b", "c"]
    assert raws("a\n  x\n\ty\nb", mode="multi") == ["a\n  x\n\ty", "b"]
    assert raws('[{"a":1},{"b":"}"}]', mode="json") == ['{"a":1}', '{"b":"}"}']
    assert raws('[{"a":1}]') == ['{"a":1}']
    assert raws("a\n  x\nb") == ["a\n  x", "b"]
    assert raws("a\nb") == ["a", "b"]
    assert raws("a;b", pattern=";") == ["a", "b"]
    assert raws("") == [] and raws(None) == []
    with pytest.raises(ValueError):
        raws("a", mode="odd")


def test_sourcetypes(spark):
    names = ["/var/log/auth.log", "/x/secure", "/x/messages", "/n/access.log", "/n/error.log", "a.json", "b.csv", "c.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(sourcetype_of(F.col("n")))
    assert [r[0] for r in df.collect()] == ["linux_secure", "linux_secure", "syslog", "access_combined", "error_log", "json", "csv", "generic_single_line"]


def test_batch_defaults_and_overrides(spark):
    rows = batch(spark, [{"raw": "x"}, {"raw": "y", "host": "h2"}, {"k": 1}], host="h", index="audit").collect()
    assert [(r.raw, r.host, r["index"], r.sourcetype) for r in rows] == [("x", "h", "audit", "json"), ("y", "h2", "audit", "json"), ('{"k": 1}', "h", "audit", "json")]
    with pytest.raises(ValueError):
        batch(spark, [])


def test_normalise(spark):
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp")
    df = spark.createDataFrame([("2024-01-15T10:30:00Z a=1 a=2", "", None, "st", "ix", 0), ("x", "h", "s", "st", "ix", 1705312200), (None, "h", "s", "st", None, None)], "raw string, host string, source string, sourcetype string, index string, timestamp_us bigint")
    got = normalise(df, now, with_fields=True).orderBy("_time").collect()
    assert [(r._time, r.host, r.source, r["index"]) for r in got] == [(datetime(2024, 1, 15, 9, 50), "h", "s", "ix"), (datetime(2024, 1, 15, 10, 30), "unknown", "http", "ix"), (datetime(2024, 2, 1), "h", "s", "main")]
    assert got[1].fields == {"a": "2"}


def test_syslog_lines_as_input(spark):
    df = spark.createDataFrame([("<13>Jan  5 10:30:00 hostB sshd[9]: Failed\r\n", "1.2.3.4"), ("\n", "1.2.3.4")], "value string, sender string")
    assert [tuple(r)[:4] for r in from_syslog(df, sender="sender").collect()] == [("<13>Jan  5 10:30:00 hostB sshd[9]: Failed", "hostB", "sshd", "syslog:user")]


def test_store_life_cycle(spark, tmp_path):
    s = EventStore(spark, str(tmp_path / "store"))
    assert s.read().count() == 0 and s.indexes() == []
    for k in range(4):
        s.append(normalise(batch(spark, [{"raw": f"2024-01-0{d}T00:00:0{k}Z é{d}", "index": "a" if d < 3 else "b"} for d in (1, 2, 3)])))
    assert s.indexes() == ["a", "b"]
    assert s.read("a").count() == 8 and s.read("a", first_day="2024-01-02").count() == 4
    stats = {r.name: r for r in s.statistics().collect()}
    assert (stats["a"].total_events, stats["a"].segment_count, stats["b"].total_events) == (8, 8, 4)
    assert stats["b"].total_size_bytes == 4 * len("2024-01-03T00:00:00Z é3".encode())
    assert len(s.compact()) == 3
    assert {r.name: r.segment_count for r in s.statistics().collect()} == {"a": 2, "b": 1}
    assert s.read().count() == 12 and s.compact() == []
    s.append(normalise(batch(spark, [{"raw": "2024-01-03T00:00:00Z é3", "index": "b"}])))
    assert s.read("b").count() == 5 and s.deduplicate("b").count() == 4
    assert s.retain("a", "2024-01-02") == 1 and s.read("a").count() == 4
    assert s.drop_index("b") and s.indexes() == ["a"]


def stored(spark, *raws, index="a"):
    return normalise(batch(spark, [{"raw": f"2024-01-01T00:00:0{k}Z {r}", "index": index} for k, r in enumerate(raws)]))


def test_rows_appended_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    s = EventStore(spark, str(tmp_path / "s"))
    for r in "abc":
        s.append(stored(spark, r))
    put = s._put

    def meanwhile(path, content):
        s.append(stored(spark, "late"))
        put(path, content)

    monkeypatch.setattr(s, "_put", meanwhile)
    assert len(s.compact()) == 1
    assert sorted(r._raw[-1] for r in s.read("a").collect()) == ["a", "b", "c", "e"]


def test_a_failed_move_loses_nothing_and_is_finished_later(spark, tmp_path, monkeypatch):
    s = EventStore(spark, str(tmp_path / "s"))
    for r in "abc":
        s.append(stored(spark, r))
    move = s._move

    def fails(moves):
        raise OSError("no")

    monkeypatch.setattr(s, "_move", fails)
    with pytest.raises(OSError):
        s.compact()
    assert s.read().count() == 3
    monkeypatch.setattr(s, "_move", move)
    assert s.recover() == 1 and s.read().count() == 3 and s.statistics().first().segment_count == 1
    assert s.recover() == 0 and s.compact() == []


def test_a_named_batch_is_added_once(spark, tmp_path, monkeypatch):
    s = EventStore(spark, str(tmp_path / "s"))
    move, times = s._move, []

    def halfway(moves):
        if not times:
            times.append(1)
            move(moves[:1])
            raise OSError("no")
        move(moves)

    monkeypatch.setattr(s, "_move", halfway)
    events = stored(spark, "x").unionByName(stored(spark, "y", index="b"))
    with pytest.raises(OSError):
        s.append(events, "n-1")
    for _ in range(2):
        s.append(events, "n-1")
    s.append(stored(spark, "z"), "n-2")
    assert sorted(r._raw[-1] for r in s.read().collect()) == ["x", "y", "z"]


def test_added_lines_are_followed(spark, tmp_path):
    log, other, out = tmp_path / "in" / "a.log", tmp_path / "in" / "b.gz", str(tmp_path / "s")
    log.parent.mkdir()
    other.write_text("no")
    log.write_bytes(b"2024-01-01T00:00:00Z one\n\nhalf")

    def run():
        write_events(files.follow_logs(spark, str(log.parent), deny="gz$"), out, str(tmp_path / "cp"), once=True).awaitTermination()
        return sorted(r._raw[-5:] for r in EventStore(spark, out).read().collect())

    assert run() == ["Z one"]
    with log.open("ab") as f:
        f.write("-line é\n2024-01-01T00:00:01Z two\nx".encode())
    assert run() == ["Z one", "Z two", "ine é"]
    assert run() == ["Z one", "Z two", "ine é"]
    log.write_bytes(b"fresh start\n")  # shorter than before
    assert run() == ["Z one", "Z two", "ine é", "start"]


def test_pieces_hold_each_line_once(tmp_path):
    from tailrace.sources.tail import TailReader

    log = tmp_path / "a.log"
    lines = [f"line {k} " + "é" * (k % 7) for k in range(50)]
    log.write_text("\n".join(lines) + "\nrest")
    for piece in (1, 5, 64, 10_000):
        r = TailReader({"path": str(log), "pieceBytes": str(piece)})
        got = [x[0] for p in r.partitions({}, r.latestOffset()) for x in r.read(p)]
        assert got == lines


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_tables_in_other_formats(spark, tmp_path, kind):
    from tailrace.plans.catalog import Catalog
    from tailrace.plans.compile import Compiler
    from tailrace.sources.tables import read_table, write_table

    df = spark.createDataFrame([(1, "disk full", "h1"), (2, "disk ok", "h2"), (3, None, "h2")], "n long, line string, host string")
    more = {"header": "true"} if kind == "csv" else {}
    write_table(df, kind, str(tmp_path / "t"), **more)
    schema = "n long, line string, host string" if kind in ("json", "csv") else None
    c = Catalog(spark)
    c.register("t", read_table(spark, kind, str(tmp_path / "t"), schema, **more), id="n", raw="line")
    got = Compiler(c).compile("search index=t disk | stats count by host").collect()
    assert sorted((r.host, r["count"]) for r in got) == [("h1", 1), ("h2", 1)]


def test_tables_that_cannot_be_read(spark, tmp_path):
    from tailrace.sources.tables import read_table

    with pytest.raises(ValueError):
        read_table(spark, "xls", "x")
    with pytest.raises(ValueError):
        read_table(spark, "csv", "x")
    with pytest.raises(RuntimeError):
        read_table(spark, "kafka", subscribe="t", **{"kafka.bootstrap.servers": "h:1"})


def test_imports(spark, tmp_path):
    (tmp_path / "i.csv").write_text("ioc_type,ioc_value,source,confidence,severity,tlp,first_seen,last_seen\nip,1.2.3.4,,x,low,white,2024-01-01T00:00:00Z,\n")
    r = files.import_feed(spark, str(tmp_path / "i.csv"), "csv", "feed").first()
    assert (r.ioc_value, r.source, r.confidence) == ("1.2.3.4", "feed", None)
    (tmp_path / "s.json").write_text('{"objects": [{"type": "indicator", "pattern": "[ipv4-addr:value = \'5.6.7.8\']", "confidence": 80, "valid_from": "2024-01-01T00:00:00Z"}, {"type": "identity"}]}')
    r = files.import_feed(spark, str(tmp_path / "s.json"), "stix", "feed").collect()
    assert [(x.ioc_type, x.ioc_value, x.confidence) for x in r] == [("ip", "5.6.7.8", 0.8)]
    with pytest.raises(ValueError):
        files.import_feed(spark, "x", "xml", "feed")


def test_read_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "access.log").write_text("one\n\ntwo\n")
    (tmp_path / "skip.tmp").write_text("no\n")
    got = files.read_logs(spark, str(tmp_path), deny=r"\.tmp$").collect()
    assert sorted((r.raw, r.sourcetype) for r in got) == [("one", "access_combined"), ("two", "access_combined")]


def test_syslog_listener_over_udp_and_tcp(spark):
    udp = sockets.SyslogReader({"protocol": "udp", "host": "127.0.0.1", "port": "0"})
    port = udp.socket.getsockname()[1]
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for m in (b"<13>a\r\n", b"\n", b"<14>b"):
        out.sendto(m, ("127.0.0.1", port))
    time.sleep(0.2)
    rows, end = udp.read(udp.initialOffset())
    assert [r[0] for r in rows] == ["<13>a", "<14>b"] and end == {"n": 2}
    assert [r[0] for r in udp.readBetweenOffsets({"n": 0}, end)] == ["<13>a", "<14>b"]
    udp.commit(end)
    assert list(udp.readBetweenOffsets({"n": 0}, end)) == []
    tcp = sockets.SyslogReader({"protocol": "tcp", "host": "127.0.0.1", "port": "0"})
    peer = socket.create_connection(("127.0.0.1", tcp.socket.getsockname()[1]))
    peer.sendall(b"one\ntwo\nthr")
    time.sleep(0.2)
    rows, end = tcp.read(tcp.initialOffset())
    assert [r[0] for r in rows] == ["one", "two"]
    peer.sendall(b"ee\n")
    peer.close()
    time.sleep(0.2)
    assert [r[0] for r in tcp.read(end)[0]] == ["three"]
    sockets.register(spark)


def test_bytes_for_reading(spark):
    df = spark.createDataFrame([(5,), (2048,), (3 * 1024**2,), (5 * 1024**3,), (None,)], "n long").select(bytes_text(F.col("n")))
    assert [r[0] for r in df.collect()] == ["5 B", "2.0 KB", "3.0 MB", "5.0 GB", None]


def test_postings(spark, tmp_path):
    from tailrace.sources.postings import Postings

    ev = spark.createDataFrame([(1, "Failed login attempt from server"), (2, "Successful login from server"), (3, "Failed connection to database"), (4, None)], "_id long, _raw string")
    p = Postings(spark, str(tmp_path / "p"))
    p.build(ev)
    assert sorted(r[0] for r in p.ids(["failed"]).collect()) == [1, 3]
    assert [r[0] for r in p.search(ev, ["failed", "LOGIN"]).select("_id").collect()] == [1]
    assert sorted(r[0] for r in p.ids(["attempt", "database", "nothing"], every=False).collect()) == [1, 3]
    assert tuple(p.statistics().first()) == (9, 13)
    accents = spark.createDataFrame([(1, "École ouverte"), (2, "école FERMÉE")], "_id long, _raw string")
    q = Postings(spark, str(tmp_path / "q"))
    q.build(accents)
    assert [r[0] for r in q.ids(["École"]).collect()] == [1] and [r[0] for r in q.ids(["FERMÉE", "école"]).collect()] == [2]
    assert Postings.union([p.read(), p.read()]).count() == 13


def test_config(tmp_path, spark):
    from tailrace.config import Config

    (tmp_path / "c.json").write_text('{"data_dir": "/x", "shuffle_partitions": 4}')
    assert Config.load(tmp_path / "c.json").data_dir == "/x"
    Config.load(tmp_path / "c.json").apply(spark)
    c = Config(data_dir=str(tmp_path / "d"), compression_level=7, segment_size_mb=1, log_file=str(tmp_path / "x.log"), log_level="warning", detection_period=3.0)
    store = c.store(spark)
    assert store.target_bytes == 1 << 20 and store.options["parquet.compression.codec.zstd.level"] == "7"
    assert c.syslog_options("tcp") == {"protocol": "tcp", "host": "0.0.0.0", "port": "5514"}
    handler = c.start_log(most_bytes=200, kept=1)
    for k in range(10):
        logging.getLogger("tailrace.any").warning("line %s", k)
    logging.getLogger("tailrace").removeHandler(handler)
    assert "line 9" in (tmp_path / "x.log").read_text() and (tmp_path / "x.log.1").exists() and Config().start_log() is None
    (tmp_path / "c.json").write_text('{"odd": 1}')
    with pytest.raises(ValueError):
        Config.load(tmp_path / "c.json")
