from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tailrace.functions import scalar
from tailrace.functions.text import extract_map, has_token, tokens
from tailrace.lang.errors import QueryError
from tailrace.plans.catalog import Catalog
from tailrace.plans.compile import Compiler, filled, interval_of


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    t = datetime(2024, 1, 1)
    data = [
        (t.replace(hour=1), 1, "a", "s1", "x", "Failed login bytes=10 user=bob", {"k": "5"}),
        (t.replace(hour=1, minute=30), 2, "b", "s1", "x", "ok bytes=9 user=\"al b\"", {"k": "10"}),
        (t.replace(hour=3), 3, "a", None, "y", '{"bytes": 12, "user": "bob"}', None),
        (t.replace(hour=3), 4, None, "s2", "y", None, {"k": "abc"}),
    ]
    c.register("main", spark.createDataFrame(data, "_time timestamp, _id long, host string, source string, sourcetype string, _raw string, fields map<string,string>"))
    c.register("other", spark.createDataFrame([(1, "z")], "num int, host string"), id="num", raw="host")
    c.register("empty", spark.createDataFrame([], "_time timestamp, _id long, host string, _raw string, n int"))
    return c


def run(cat, q, mode="typed", **kw):
    return [tuple(r) for r in Compiler(cat, mode).compile(q, **kw).collect()]


def test_unknown_index_is_empty_and_star_is_all(cat):
    assert run(cat, "search index=nope | table host") == []
    assert len(run(cat, "search index=* | table host")) == 5


def test_terms_phrases_selectors(cat):
    assert run(cat, "search index=main failed | table _id") == [(1,)]
    assert run(cat, 'search index=main "LED LOG" | table _id') == [(1,)]
    assert run(cat, "search index=main fai* | table _id") == [(1,)]
    assert run(cat, "search index=main faile | table _id") == []
    assert {r[0] for r in run(cat, "search index=main * | table _id")} == {1, 2, 3, 4}
    assert {r[0] for r in run(cat, "search index=main NOT failed | table _id")} == {2, 3, 4}
    assert {r[0] for r in run(cat, "search index=main host!=a | table _id")} == {2}
    assert {r[0] for r in run(cat, "search index=main NOT host=a | table _id")} == {2, 4}


def test_fields_from_map_pairs_and_json(cat):
    assert dict(run(cat, "search index=main | table _id user")) == {1: "bob", 2: "al b", 3: "bob", 4: None}
    assert dict(run(cat, "search index=main | where bytes > 9 | table _id bytes")) == {1: "10", 3: "12"}
    assert {r[0] for r in run(cat, "search index=main k>=10 | table _id")} == {2, 4}


def test_typed_sort_puts_numbers_by_value(cat):
    assert [r[0] for r in run(cat, "search index=main | sort bytes | table bytes")] == ["9", "10", "12", None]
    assert [r[0] for r in run(cat, "search index=main | sort -bytes | head 2 | table bytes")] == ["12", "10"]
    assert [r[0] for r in run(cat, "search index=main | sort bytes | table bytes", "compat")] == [None, "10", "12", "9"]


def test_stats_forms(cat):
    assert run(cat, "search index=main | stats count by host | sort host") == [("a", 2), ("b", 1), (None, 1)]
    assert run(cat, "search index=main | stats count(host) AS n, dc(host) AS d, values(host) AS v, first(_id) AS f, last(_id) AS l") == [(3, 2, "a, b", 1, 4)]
    assert run(cat, "search index=main | stats list(host) AS h") == [(["a", "b", "a"],)]
    assert run(cat, "search index=main | stats sum(bytes) AS s, avg(bytes) AS a, min(bytes) AS lo, max(bytes) AS hi") == [(31.0, 31 / 3, "9.0", "12.0")]
    assert run(cat, "search index=empty | stats count, sum(n) AS s") == []
    assert run(cat, "search index=empty | stats count by host") == []
    assert run(cat, "search index=main nothing | stats min(n) AS lo") == []


def test_order_of_first_last_and_list(cat):
    assert run(cat, "search index=main | sort -_id | stats first(_id) AS f, last(_id) AS l, list(_id) AS x") == [(4, 1, ["4", "3", "2", "1"])]
    assert run(cat, "search index=main | sort -host, -_id | stats list(_id) AS x") == [(["2", "3", "1", "4"],)]
    assert run(cat, "search index=main | sort -bytes | stats list(_id) AS x, first(_id) AS f") == [(["3", "1", "2", "4"], 3)]
    with pytest.raises(QueryError):
        run(cat, "search index=main | stats count AS host by host")


def test_compat_aggregates(cat):
    q = "search index=main | stats count(host) AS n, dc(host) AS d, sum(k) AS s, avg(nope) AS a by sourcetype | sort sourcetype"
    assert run(cat, q, "compat") == [("x", 2, 2, "15.000000", "0"), ("y", 2, 2, "0.000000", "0")]


def test_order_dependent_commands(cat):
    assert [r[0] for r in run(cat, "search index=main | head 2 | table _id")] == [1, 2]
    assert [r[0] for r in run(cat, "search index=main | tail 2 | table _id")] == [3, 4]
    assert [r[0] for r in run(cat, "search index=main | sort -_id | tail 2 | table _id")] == [2, 1]
    assert run(cat, "search index=main | dedup host | table _id host") == [(1, "a"), (2, "b")]
    assert run(cat, "search index=main | head 0 | table _id") == []


def test_timechart_and_filling(cat):
    c = Compiler(cat).compile("search index=main | timechart span=1h count")
    assert [(r[0].hour, r[1]) for r in c.orderBy("_time").collect()] == [(1, 2), (3, 2)]
    assert [(r[0].hour, r[1]) for r in filled(c, "1h", "count").orderBy("_time").collect()] == [(1, 2), (2, 0), (3, 2)]
    assert Compiler(cat).compile("search index=empty | timechart count").count() == 0
    assert interval_of("15m") == "15 minutes"
    with pytest.raises(QueryError):
        interval_of("3 parsecs")


def test_time_bounds(cat):
    assert {r[0] for r in run(cat, "search index=main earliest=2024-01-01T01:30:00 | table _id")} == {2, 3, 4}
    assert {r[0] for r in run(cat, "search index=main | table _id", latest="2024-01-01T01:00:00Z")} == {1}
    got = [r[0] for r in Compiler(cat, now=datetime(2024, 1, 1, 3, 30)).compile("search index=main earliest=-1h | table _id").collect()]
    assert sorted(got) == [3, 4]


def test_rename_eval_rex(cat):
    assert run(cat, "search index=main | rename host AS h, user AS u | sort _id | head 1 | table h u") == [("a", "bob")]
    assert run(cat, 'search index=main | eval z = 1 / 0, c = "a" . host, n = null | sort _id | head 1 | table z c n') == [(None, "aa", None)]
    assert run(cat, 'search index=main | rex "user=(?<the_user>\\w+)" | sort _id | head 1 | table the_user') == [("bob",)]
    with pytest.raises(QueryError):
        run(cat, 'search index=main | rex "nothing"')
    with pytest.raises(QueryError):
        run(cat, "search index=main | eval x = nofunction(1)")
    with pytest.raises(QueryError):
        run(cat, "search index=main | eval x = if(1)")


def test_two_valued_logic(cat):
    assert {r[0] for r in run(cat, 'search index=main | where not source = "s1" | table _id')} == {3, 4}
    assert {r[0] for r in run(cat, 'search index=main | where source != "s1" | table _id')} == {4}
    assert {r[0] for r in run(cat, "search index=main | where isnull(source) or k in (5, 6) | table _id")} == {1, 3}


def test_registered_function(cat):
    scalar.register("twice", lambda v: scalar.Value(scalar.num(v[0]) * 2, "double"), 1, 1)
    assert run(cat, "search index=main | eval t = twice(_id) | sort _id | head 1 | table t") == [(2.0,)]


def test_filters_reach_the_scan_and_columns_are_pruned(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(datetime(2024, 1, 1), 1, "a", "r", 5)], "_time timestamp, _id long, host string, _raw string, n int").write.parquet(p)
    c = Catalog(spark)
    c.register("t", lambda: spark.read.parquet(p))
    plan = Compiler(c).compile("search index=t host=a | where n > 3 | stats count by host")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(host,a)" in plan and "GreaterThan(n,3)" in plan
    assert "_raw" not in plan.split("ReadSchema")[1]


def _model_tokens(text):
    out, cur = [], b""
    for ch in text.encode():
        if bytes([ch]).isspace() or chr(ch) in "=,;:\"'[](){}<>":
            out.append(cur)
            cur = b""
        else:
            cur += bytes([ch]).lower() if ch < 128 else bytes([ch])
    return [t.decode() for t in [*out, cur] if len(t) >= 2]


def test_tokens_against_a_byte_model(spark):
    texts = ["Failed Login from=10.0.0.1", "É=ü a bb;CC", "", "x", "[a-b]{C_d}<e>", "tab\tnew\nline", "ÀÉ ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [_model_tokens(t) for t in texts]
    got = spark.createDataFrame([("Failed login",), ("error in A",), (None,)], "t string").select(has_token(F.col("t"), "FAILED")).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_pairs_as_map(spark):
    df = spark.createDataFrame([('a=1,b="x y" a=2',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(extract_map(F.col("t"))).collect()] == [{"a": "2", "b": "x y"}, {}, {}]


def test_time_bounds_prune_days_of_the_store(spark, tmp_path):
    from tailrace.api import Engine

    e = Engine(spark, str(tmp_path / "s"))
    e.ingest([{"raw": f"2024-01-0{d}T00:00:00Z x"} for d in (1, 2, 3)])
    df = e.dataframe("search index=main earliest=2024-01-02 | stats count")
    assert df.first()[0] == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert '"total_count": 1' in e.execute("search index=main earliest=2024-01-03 | table _time").to_json()
