import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tailrace.api import Engine
from tailrace.detect import enrich, notables
from tailrace.detect.conditions import met
from tailrace.detect.engine import Detector, over_threshold, single_scan
from tailrace.detect.rules import BUILTIN, Rule
from tailrace.lang.errors import QueryError
from tests.events import SAMPLE

GOLDEN = {
    "BF-001": {"tower.example.net": 3, "shop-2": 3},
    "BF-002": {"tower.example.net": 1, "shop-2": 1},
    "PE-001": {"tower.example.net": 1},
    "PE-002": {"shop-2": 1},
    "FW-001": {"gate-7": 1},
    "FW-002": {"gate-7": 1},
    "WEB-001": {"shop-2": 1},
    "WEB-002": {"shop-2": 1},
    "NET-001": {"gate-7": 2},
    "WEB-003": {"shop-2": 3},
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("data") / "store"))
    for sourcetype, host, raws in SAMPLE:
        assert e.ingest([{"raw": r} for r in raws], sourcetype=sourcetype, host=host, source=sourcetype, index="main") == 5
    return e


def test_sample_searches(engine):
    assert engine.execute("search index=main").total_count == 20
    assert engine.execute("search index=main failed").total_count == 6
    r = engine.execute("search index=main | stats count by host | sort -count | head 5")
    assert [x["count"] for x in r.events] == [10, 5, 5]
    assert r.columns == ["host", "count"] and r.stats["rows"][0] == ["shop-2", 10]
    compat = engine.execute("search index=main | stats count by host | sort -count | head 5", mode="compat")
    assert [x["count"] for x in compat.events] == [5, 5, 10]
    assert len(engine.execute("search index=main | stats count by sourcetype").events) == 4


def test_limits_errors_and_parse(engine):
    r = engine.execute("search index=main | table host", max_results=3)
    assert (r.total_count, len(r.events)) == (20, 3)
    with pytest.raises(ValueError):
        engine.execute("search index=main", max_results=0)
    with pytest.raises(QueryError):
        engine.execute("search index=main | nonsense")
    assert engine.parse("search index=main error | stats count by host") == {"valid": True, "errors": [], "commands": ["search", "stats"], "indexes": ["main"], "fields": ["_raw", "host"]}
    assert engine.parse("x | y")["valid"] is False
    assert engine.health()["status"] == "ok"
    assert engine.list_indexes()[0]["total_events"] == 20
    assert set(engine.dashboard()) == {"events over time", "findings by severity", "top sources"}


def test_every_builtin_rule_matches_as_expected(engine):
    got = {}
    for rule in BUILTIN:
        search = rule.query.split("|")[0]
        got[rule.id] = {r["host"]: r["count"] for r in engine.execute(search + "| stats count by host").events}
    assert got == GOLDEN
    one = {}
    for r in single_scan(engine.catalog, BUILTIN).collect():
        one.setdefault(r.rule_id, {})[r.host] = r.n
    assert one == GOLDEN


def test_single_scan_does_all_that_a_rule_says(engine, spark):
    def scan(*queries, **more):
        rules = [Rule(f"R-{k}", "", "", "low", q, **more) for k, q in enumerate(queries)]
        return {(r.rule_id, r.host): r.n for r in single_scan(engine.catalog, rules).collect()}

    by_host = "search index=main failed | stats count by host"
    assert set(scan(by_host).values()) == {3}
    assert scan(by_host + " | where count >= 3", by_host + " | where count >= 4", by_host.replace("count by", "count AS c by") + ' | where c > 2 | where host = "shop-2"') == {
        ("R-0", "tower.example.net"): 3, ("R-0", "shop-2"): 3, ("R-2", "shop-2"): 3,
    }
    early, late = 'earliest="2031-05-02T08:00:05"', 'latest="2031-05-02T08:00:05"'
    one_by_one = {q: {r["host"]: r["count"] for r in engine.execute(q).events} for q in (by_host.replace("failed", f"failed {early} {late}"), by_host.replace("failed", f"failed {early}"))}
    for q, expect in one_by_one.items():
        assert {h: n for (_, h), n in scan(q).items()} == expect
    assert scan(by_host, earliest="2100-01-01T00:00:00") == {}
    for q in (by_host.replace("main", "other"), by_host + " | head 1", "search index=main | stats dc(source) by host"):
        with pytest.raises(ValueError):
            scan(q)
    # counts of batches are summed before the threshold
    rule = BUILTIN[0]
    summed = spark.createDataFrame([(rule.id, "a", 2), (rule.id, "b", 3), ("BF-002", "a", 1)], "rule_id string, host string, n long")
    assert sorted(r.host for r in over_threshold(summed, BUILTIN).collect()) == ["a", "b"]


def test_rules_fire_and_failures_are_isolated(engine):
    store = notables.NotableStore()
    d = Detector(engine.catalog, store)
    d.add_rule(Rule("X-1", "broken", "", "low", "search index=main | nonsense"))
    d.add_rule(Rule("X-2", "never", "", "low", "search index=main nosuchword | stats count by host"))
    found = d.run_all()
    assert {n["rule_id"] for n in found} == set(GOLDEN)
    n = next(n for n in found if n["rule_id"] == "BF-001")
    assert n["host"] == "shop-2, tower.example.net" and n["contributing_events"][0]["count"] == "3"
    assert store.count_by_severity() == {"high": 2, "critical": 3, "medium": 4, "low": 1} and store.count_open() == 10
    d.run_all()
    assert len(store.list(limit=100)) == 20


def test_conditions(spark):
    df = spark.createDataFrame([("a", 3), ("b", 9)], "host string, count long")
    assert met(df, {"count_gt": 8}) and not met(df, {"count_gt": 9}) and met(df, {"count_gt": 1})
    assert met(df, {"count_ge": 9}) and not met(df, {"count_ge": 10})
    assert met(df, {}) and not met(df.limit(0), {}) and not met(df.limit(0), {"count_gt": 0})
    assert met(df.select("host"), {"count_gt": 1})


def test_store_status_cap_and_pages():
    s = notables.NotableStore(cap=3)
    rule = BUILTIN[0]
    ids = []
    for k in range(5):
        n = notables.notable(rule, "h", [])
        n["created_at"] += timedelta(seconds=k)
        s.add(n)
        ids.append(n["id"])
    assert [n["id"] for n in s.list()] == ids[:1:-1]
    assert [n["id"] for n in s.list(limit=1, offset=1)] == [ids[3]]
    assert s.get(ids[0]) is None
    assert s.update_status(ids[4], "closed")["status"] == "closed" and s.count_open() == 2
    assert s.list(status="closed")[0]["id"] == ids[4] and s.list(severity="low") == []
    assert s.update_status("none", "new") is None
    with pytest.raises(ValueError):
        s.update_status(ids[4], "odd")


def test_indicators_assets_and_risk(spark, rows):
    ioc = spark.createDataFrame([("1.2.3.4", 0.5), (" 1.2.3.4 ", 0.9), ("evil.example", 0.1), (None, 1.0), ("", 1.0)], "ioc_value string, confidence double")
    ev = spark.createDataFrame([(1, "to 1.2.3.4 and 1.2.3.4", "H1."), (2, "EVIL.example;x", "h2"), (3, "1.2.3.40", None), (4, None, "h1")], "_id long, _raw string, host string")
    assert rows(enrich.matches(ev, ioc)) == [(1, "1.2.3.4", 0.9), (2, "evil.example", 0.1)]
    assert rows(enrich.matches(ev, ioc.limit(0))) == []
    assets = spark.createDataFrame([("a2", "h1", "low", None, None), ("a1", "H1 ", "high", None, None), ("a3", None, "x", None, None)], "asset_id string, hostname string, criticality string, business_unit string, location string")
    assert rows(enrich.with_assets(ev, assets), "_id", "asset_id", "criticality") == [(1, "a1", "high"), (2, None, None), (3, None, None), (4, "a1", "high")]
    n = spark.createDataFrame([("h", "r1", 50), ("h", "r2", 30), ("g", "r1", 20), ("", "r1", 99), (None, "r1", 99), ("k", "r1", None)], "host string, rule_id string, risk_score int")
    assert rows(enrich.risk(n)) == [("g", 20, 1, "low"), ("h", 80, 2, "critical"), ("k", 0, 1, "low")]


def test_success_after_failures(spark, rows):
    t = datetime(2024, 1, 1, 0, 50)
    data = [(1, t, "h", "bad"), (2, t + timedelta(minutes=20), "h", "bad"), (3, t + timedelta(minutes=59), "h", "ok"), (4, t + timedelta(minutes=61), "h", "ok"), (5, t + timedelta(minutes=21), "g", "ok"), (6, None, "h", "ok")]
    df = spark.createDataFrame(data, "_id long, _time timestamp, host string, what string")
    got = enrich.success_after_failures(df, F.col("what") == "bad", F.col("what") == "ok", ["host"], within="1 hour", least=1)
    assert rows(got, "_id", "n_refused") == [(3, 2), (4, 1)]


def test_stored_notables(spark, rows):
    t = datetime(2024, 1, 1)
    n = spark.createDataFrame([(1, "a", "r", "High ", "new", "h", t), (2, "a", "r", "high", "closed", "h", t), (3, "b", "r", "low", "new", "h", t + timedelta(hours=2)), (4, None, "r", None, None, None, None)], "row_id long, id string, rule_id string, severity string, status string, host string, created_at timestamp")
    assert rows(notables.latest_states(n), "row_id") == [(2,), (3,)]
    assert rows(notables.by_severity(n)) == sorted([("high", 2), ("low", 1), (None, 1)], key=repr)
    assert [r.row_id for r in notables.page(n, severity="HIGH").collect()] == [2, 1]
    assert rows(notables.throttled(n), "row_id") == [(1,), (3,)]
    assert rows(notables.capped(n, 2), "row_id") == [(3,), (4,)]


def test_refused_logins_are_counted_like_brute_force(spark, rows):
    rnd = random.Random(9)
    t = datetime(2024, 1, 1)
    data = [(k, t + timedelta(minutes=rnd.randrange(400)), rnd.choice(["h", "g", None]), rnd.choice(["bad", "bad", "ok", None])) for k in range(400)]
    df = spark.createDataFrame(data, "_id long, _time timestamp, host string, what string")
    got = rows(enrich.success_after_failures(df, F.col("what") == "bad", F.col("what") == "ok", ["host"], within="90 minutes", least=2), "_id", "n_refused")
    count = lambda a, h: sum(w == "bad" and x == h and a - timedelta(minutes=90) <= b < a for _, b, x, w in data)
    assert got == sorted([(k, count(a, h)) for k, a, h, w in data if w == "ok" and h is not None and count(a, h) >= 2], key=repr)
    assert rows(enrich.success_after_failures(df.limit(0), F.col("what") == "bad", F.col("what") == "ok", ["host"])) == []


def test_identities_join_by_name_or_mail(spark, rows):
    people = spark.createDataFrame([("mira", "m@x", "Mira", "ops", "high", 3.0), ("aa", " M@X ", "Other", "dev", "low", 1.0), (None, None, "Nobody", None, None, None)], "username string, email string, full_name string, department string, priority string, risk_score double")
    ev = spark.createDataFrame([(1, "MIRA ", "own"), (2, "m@x", "own"), (3, None, "own"), (4, "zed", "own")], "_id long, user string, department string")
    assert rows(enrich.with_identities(ev, people), "_id", "full_name", "department", "identity_department") == [(1, "Mira", "own", "ops"), (2, "Other", "own", "dev"), (3, None, "own", None), (4, None, "own", None)]


def test_findings_in_a_table_survive(spark, tmp_path, rows):
    store = notables.NotableTable(spark, str(tmp_path / "n"))
    assert store.current().count() == 0 and store.update_status("x", "closed") is False
    found = [notables.notable(BUILTIN[k], "h", [{"host": "h", "count": k, "gone": None}]) for k in range(2)]
    store.add(found)
    assert store.update_status(found[0]["id"], "resolved")
    again = notables.NotableTable(spark, str(tmp_path / "n"))
    assert rows(again.current(), "id", "status") == sorted([(found[0]["id"], "resolved"), (found[1]["id"], "new")], key=repr)
    assert again.states().count() == 3 and notables.by_severity(again.current()).count() == 2
    assert rows(notables.contributing(again.current()), "event_no", "key", "value") == [(0, "count", "0"), (0, "count", "1"), (0, "host", "h"), (0, "host", "h")]
    with pytest.raises(ValueError):
        again.update_status(found[0]["id"], "odd")


def test_jobs_in_the_background(engine):
    job = engine.submit("search index=main | stats count by host", max_results=10)
    assert job.result(60).total_count == 3 and job.status == "done"
    assert set(job.progress()) == {"tasks", "done"}
    bad = engine.submit("search index=main | nonsense")
    with pytest.raises(QueryError):
        bad.result(60)
    assert bad.status == "failed"


def test_metrics_and_tags(engine):
    engine.execute("search index=main | head 1", tag="t1")
    engine.cancel("t1")
    text = engine.metrics.text()
    assert "tailrace_events_total 20" in text and "tailrace_queries_total" in text and 'tailrace_query_ms_bucket{le="+Inf"}' in text
    engine.metrics.set("open", 3)
    assert "# TYPE tailrace_open gauge" in engine.metrics.text()
