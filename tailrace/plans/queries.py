"""Queries of the piped language and the detection layer over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace import written_sql
from tailrace.detect import enrich, notables
from tailrace.api import Engine
from tailrace.detect.conditions import met
from tailrace.detect.engine import single_scan
from tailrace.detect.rules import BUILTIN, Rule
from tailrace.functions.syslog import FACILITIES, SEVERITIES, has_envelope, syslog_fields
from tailrace.functions.text import bytes_text, tokens
from tailrace.functions.instants import micros_of_number
from tailrace.io import host_key, saved, scratch, table
from tailrace.operators.instants import normalise_written_times
from tailrace.operators.panes import PaneSpec
from tailrace.plans.catalog import Catalog
from tailrace.plans.compile import Compiler, filled, wide
from tailrace.queries import SQL as core_sql
from tailrace.sources.normalise import normalise
from tailrace.sources.lines import break_lines, sourcetype_of
from tailrace.sources.postings import Postings
from tailrace.streaming.panes import PaneStore, start


def catalog(spark: SparkSession, d: str) -> Catalog:
    """The test tables as indexes: events, documents, main (wire_event) and notable."""
    c = Catalog(spark)
    t = lambda n: table(spark, d, n)
    k = F.get_json_object("props", "$.k")
    c.register(
        "events",
        lambda: t("events").withColumn("value", F.col("value").cast("decimal(18,2)")),
        time="ts", id="event_id", source="event_type", sourcetype=F.lit("events"),
        host=F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")),
        raw=F.concat(F.lit("event_type="), "event_type", F.lit(" user_id="), F.col("user_id").cast("string"), F.lit(" k="), k),
        fields=F.create_map(F.lit("k"), k),
    )
    c.register("documents", lambda: t("documents").select("doc_id", "published_at", "text", F.col("source").alias("origin"), "lang", "n_chars", "doc_kind"), time="published_at", id="doc_id", source="origin", sourcetype="doc_kind", raw="text")
    c.register("main", lambda: t("wire_event"), time="received_at", id="delivery_id", raw="raw")
    c.register("notable", lambda: t("notable"), time="created_at", id="row_id", source="source", raw="description", sourcetype=F.lit("notable"))
    return c


_E = """e AS (SELECT ts AS _time, event_id AS _id, 'events' AS index, 'host-' || CAST(user_id % 10 AS VARCHAR) AS host, event_type AS source, 'events' AS sourcetype,
'event_type=' || event_type || ' user_id=' || CAST(user_id AS VARCHAR) || ' k=' || json_extract_string(props, '$.k') AS _raw, json_extract_string(props, '$.k') AS k,
CAST(value AS DECIMAL(18,2)) AS value, user_id, event_type FROM events)"""
_W = f"WITH {_E} "
_TOKENS = r"""list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\s=,;:"''\[\](){}<>]+'), lambda t: strlen(t) >= 2)"""
_BUCKET = "strftime(time_bucket(INTERVAL '{}', _time, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')"
_TEXT_TIME = ' | eval bucket = strftime(_time, "%Y-%m-%d %H:%M:%S") | fields - _time'
_HOST = r"regexp_replace(lower(trim({})), '\.$', '')"

# name -> (query, SQL)
PIPED: dict[str, tuple[str, str]] = {
    "m0_flagship": (
        "search index=events error | stats count by host | sort -count | head 10",
        _W + "SELECT host, count(*) AS count FROM e WHERE event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    # scans
    "index_scan": ("search index=events | table _id host source sourcetype _raw", _W + "SELECT _id, host, source, sourcetype, _raw FROM e"),
    "index_star_union": (
        "search index=* | stats count by index",
        "SELECT 'events' AS index, count(*) AS count FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'main', count(*) FROM wire_event UNION ALL SELECT 'notable', count(*) FROM notable",
    ),
    "index_wildcard": ("search index=doc* | stats count by sourcetype", "SELECT doc_kind AS sourcetype, count(*) AS count FROM documents GROUP BY 1"),
    "index_unknown": ("search index=nothing | stats count by host", _W + "SELECT host, count(*) AS count FROM e WHERE false GROUP BY 1"),
    "time_range": (
        'search index=events earliest="2024-01-05T00:00:00" latest="2024-01-10T12:00:00" | stats count by source',
        _W + "SELECT source, count(*) AS count FROM e WHERE _time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1",
    ),
    "selector_host": ('search index=events host="host-3" | stats count by source', _W + "SELECT source, count(*) AS count FROM e WHERE host = 'host-3' GROUP BY 1"),
    "selector_source_wildcard": ("search index=events source=s* sourcetype=events | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE source LIKE 's%' GROUP BY 1"),
    # text search
    "search_term": ("search index=events error | table _id", _W + "SELECT _id FROM e WHERE event_type = 'error'"),
    "search_term_case": ("search index=events ERROR | stats count", _W + "SELECT count(*) AS count FROM e WHERE event_type = 'error' HAVING count(*) > 0"),
    "search_and": ("search index=events click 42 | table _id", _W + "SELECT _id FROM e WHERE event_type = 'click' AND (user_id = 42 OR k = '42')"),
    "search_or_paren": ("search index=events (click OR view) NOT k=7 | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE event_type IN ('click', 'view') AND NOT coalesce(k = '7', false) GROUP BY 1"),
    "search_not": ("search index=events NOT error | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE event_type <> 'error' GROUP BY 1"),
    "search_phrase": ('search index=documents "night shift" | table _id', "SELECT doc_id AS _id FROM documents WHERE lower(text) LIKE '%night shift%'"),
    "search_wildcard": ("search index=events sig* | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE event_type LIKE 'sig%' GROUP BY 1"),
    "search_documents_token": ("search index=documents journal | table _id", f"SELECT doc_id AS _id FROM documents WHERE list_contains({_TOKENS}, 'journal')"),
    "search_after_pipe": ("search index=events | search click | stats count by host", _W + "SELECT host, count(*) AS count FROM e WHERE event_type = 'click' GROUP BY 1"),
    "search_in": ("search index=events source IN (click, signup) | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE source IN ('click', 'signup') GROUP BY 1"),
    # where
    "where_eq": ('search index=events | where event_type = "click" | stats count by host', _W + "SELECT host, count(*) AS count FROM e WHERE event_type = 'click' GROUP BY 1"),
    "where_neq": ('search index=events | where event_type != "click" | stats count by host', _W + "SELECT host, count(*) AS count FROM e WHERE event_type <> 'click' GROUP BY 1"),
    "where_lt_gt": ("search index=events | where value > 20 and value <= 60.5 | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE value > 20 AND value <= 60.5 GROUP BY 1"),
    "where_gte": ("search index=events | where user_id >= 100 | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE user_id >= 100 GROUP BY 1"),
    "where_and_or_not": (
        'search index=events | where (source = "click" or source = "view") and not user_id < 50 | stats count by host',
        _W + "SELECT host, count(*) AS count FROM e WHERE source IN ('click', 'view') AND NOT user_id < 50 GROUP BY 1",
    ),
    "where_in": ('search index=events | where event_type in ("click", "view") and user_id not in (1, 2, 3) | stats count by source', _W + "SELECT source, count(*) AS count FROM e WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3) GROUP BY 1"),
    "where_like": ('search index=events | where event_type like "%i%" | stats count by source', _W + "SELECT source, count(*) AS count FROM e WHERE event_type LIKE '%i%' GROUP BY 1"),
    "where_field_vs_field": ("search index=events | where user_id > k | stats count by source", _W + "SELECT source, count(*) AS count FROM e WHERE user_id > CAST(k AS BIGINT) GROUP BY 1"),
    "where_missing_not": ('search index=events | where not nowhere = "x" | stats count by source', _W + "SELECT source, count(*) AS count FROM e GROUP BY 1"),
    "where_function": ('search index=events | where len(event_type) > 5 and match(event_type, "^[pq]") | stats count by source', _W + "SELECT source, count(*) AS count FROM e WHERE length(event_type) > 5 AND regexp_matches(event_type, '^[pq]') GROUP BY 1"),
    # projection
    "table_missing": ("search index=events | table _id, nowhere | where isnull(nowhere) | stats count", _W + "SELECT count(*) AS count FROM e HAVING count(*) > 0"),
    "fields_include": ("search index=events | fields + _id, source", _W + "SELECT _id, source FROM e"),
    "fields_exclude": ("search index=events | fields - _time, index, _raw, fields, ts, props, value, event_id, sourcetype", _W + "SELECT _id, host, source, user_id, event_type FROM e"),
    "rename": ("search index=events | rename user_id AS uid, event_type AS kind | table _id uid kind", _W + "SELECT _id, user_id AS uid, event_type AS kind FROM e"),
    # stats
    "stats_count": ("search index=events | stats count", _W + "SELECT count(*) AS count FROM e HAVING count(*) > 0"),
    "stats_count_field": ("search index=documents | stats count(lang) AS n, count by sourcetype", "SELECT doc_kind AS sourcetype, count(lang) AS n, count(*) AS count FROM documents GROUP BY 1"),
    "stats_sum_avg": (
        "search index=events | stats sum(value) AS total, avg(value) AS mean by source",
        _W + "SELECT source, CAST(sum(value) AS DOUBLE) AS total, CAST(sum(value) AS DOUBLE) / count(value) AS mean FROM e GROUP BY 1",
    ),
    "stats_sum_int": ("search index=events | stats sum(user_id) AS total by host", _W + "SELECT host, CAST(sum(user_id) AS BIGINT) AS total FROM e GROUP BY 1"),
    "stats_min_max": ("search index=events | stats min(value) AS lo, max(value) AS hi, min(event_type) AS first_name by host", _W + "SELECT host, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi, min(event_type) AS first_name FROM e GROUP BY 1"),
    "stats_dc": ("search index=events | stats dc(user_id) AS users by source", _W + "SELECT source, count(DISTINCT user_id) AS users FROM e GROUP BY 1"),
    "stats_values": ("search index=events | stats values(event_type) AS kinds by host", _W + "SELECT host, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM e GROUP BY 1"),
    "stats_list": (
        'search index=events | stats list(event_type) AS kinds by user_id, source | eval kinds = mvjoin(kinds, ",")',
        _W + "SELECT user_id, source, string_agg(event_type, ',' ORDER BY _time, _id) AS kinds FROM e GROUP BY 1, 2",
    ),
    "stats_list_users": (
        'search index=events | stats list(event_type) AS kinds by user_id | eval kinds = mvjoin(kinds, ",")',
        _W + "SELECT user_id, string_agg(event_type, ',' ORDER BY _time, _id) AS kinds FROM e GROUP BY 1",
    ),
    "stats_first_last": ("search index=events | stats first(event_type) AS a, last(event_type) AS z by host", _W + "SELECT host, arg_min(event_type, (_time, _id)) AS a, arg_max(event_type, (_time, _id)) AS z FROM e GROUP BY 1"),
    "stats_multi_key": ("search index=events | stats count, dc(user_id) AS users by host, source", _W + "SELECT host, source, count(*) AS count, count(DISTINCT user_id) AS users FROM e GROUP BY 1, 2"),
    "stats_null_group": ("search index=documents | stats count by lang", "SELECT lang, count(*) AS count FROM documents GROUP BY 1"),
    "stats_empty_input": ("search index=events nosuchword | stats count, sum(value) AS total", _W + "SELECT count(*) AS count, CAST(sum(value) AS DOUBLE) AS total FROM e WHERE false HAVING count(*) > 0"),
    "stats_where": ("search index=events | stats count by user_id | where count > 40", _W + "SELECT user_id, count(*) AS count FROM e GROUP BY 1 HAVING count(*) > 40"),
    # time
    "timechart_1h": ("search index=events | timechart span=1h count" + _TEXT_TIME, _W + f"SELECT {_BUCKET.format('1 hour')} AS bucket, count(*) AS count FROM e GROUP BY 1"),
    "timechart_by": ("search index=events | timechart span=1d avg(user_id) AS mean by source" + _TEXT_TIME, _W + f"SELECT {_BUCKET.format('1 day')} AS bucket, source, avg(user_id) AS mean FROM e GROUP BY 1, 2"),
    "timechart_7d": ("search index=events | timechart span=7d count, dc(host) AS hosts" + _TEXT_TIME, _W + f"SELECT {_BUCKET.format('7 days')} AS bucket, count(*) AS count, count(DISTINCT host) AS hosts FROM e GROUP BY 1"),
    "timechart_default_span": ("search index=events | timechart count" + _TEXT_TIME, _W + f"SELECT {_BUCKET.format('1 day')} AS bucket, count(*) AS count FROM e GROUP BY 1"),
    # order
    "sort_num": ("search index=events | stats sum(user_id) AS n by user_id | sort -n | head 20", _W + "SELECT user_id, CAST(sum(user_id) AS BIGINT) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "sort_multi": ("search index=events | sort -user_id, +event_type | head 50 | table _id", _W + "SELECT _id FROM e ORDER BY user_id DESC, event_type, _time, _id LIMIT 50"),
    "sort_limit": ("search index=events | sort 25 -value | table _id", _W + "SELECT _id FROM e ORDER BY value DESC, _time, _id LIMIT 25"),
    "sort_numbers_in_text": ("search index=events | sort -k | head 30 | table _id k", _W + "SELECT _id, k FROM e ORDER BY CAST(k AS DOUBLE) DESC NULLS LAST, k DESC, _time, _id LIMIT 30"),
    "head": ("search index=events | head 15 | table _id", _W + "SELECT _id FROM e ORDER BY _time, _id LIMIT 15"),
    "tail": ("search index=events | tail 15 | table _id", _W + "SELECT _id FROM e ORDER BY _time DESC, _id DESC LIMIT 15"),
    "topk": ("search index=* | stats count by source | sort -count | head 10", """WITH u AS (SELECT event_type AS source FROM events UNION ALL SELECT source FROM documents UNION ALL SELECT source FROM wire_event UNION ALL SELECT source FROM notable)
SELECT source, count(*) AS count FROM u GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10"""),
    # rows
    "dedup_1": ("search index=events | dedup user_id | table _id user_id", _W + "SELECT _id, user_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _time, _id) = 1"),
    "dedup_n": ("search index=events | dedup 2 host, source | table _id", _W + "SELECT _id FROM e QUALIFY row_number() OVER (PARTITION BY host, source ORDER BY _time, _id) <= 2"),
    # eval
    "eval_arithmetic": ("search index=events | eval z = user_id * 2 + 1 - 3, h = user_id / 4, r = user_id % 7 | table _id z h r", _W + "SELECT _id, user_id * 2 + 1 - 3 AS z, user_id / 4.0::DOUBLE AS h, CAST(user_id % 7 AS DOUBLE) AS r FROM e"),
    "eval_if_case": (
        'search index=events | eval size = if(value > 50, "big", "small"), kind = case(event_type = "error", "bad", event_type = "purchase", "good", true(), "other") | stats count by size, kind',
        _W + "SELECT CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS size, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'other' END AS kind, count(*) AS count FROM e GROUP BY 1, 2",
    ),
    "eval_strings": (
        'search index=events | eval u = upper(event_type), s = substr(event_type, 2, 3), n = len(_raw), j = event_type . "/" . host, w = replace(host, "host-", "h") | table _id u s n j w',
        _W + "SELECT _id, upper(event_type) AS u, substr(event_type, 2, 3) AS s, CAST(length(_raw) AS INTEGER) AS n, event_type || '/' || host AS j, replace(host, 'host-', 'h') AS w FROM e",
    ),
    "eval_coalesce": ('search index=documents | eval l = lower(coalesce(lang, "none")) | stats count by l', "SELECT lower(coalesce(lang, 'none')) AS l, count(*) AS count FROM documents GROUP BY 1"),
    "eval_round": ("search index=events | eval r = floor(value), c = ceil(value), a = abs(0 - value) | table _id r c a", _W + "SELECT _id, CAST(floor(CAST(value AS DOUBLE)) AS BIGINT) AS r, CAST(ceil(CAST(value AS DOUBLE)) AS BIGINT) AS c, abs(0 - CAST(value AS DOUBLE)) AS a FROM e"),
    "eval_minmax": ("search index=events | eval lo = min(user_id, 50), hi = max(user_id, 50) | stats sum(lo) AS lo, sum(hi) AS hi", _W + "SELECT CAST(sum(least(user_id, 50)) AS BIGINT) AS lo, CAST(sum(greatest(user_id, 50)) AS BIGINT) AS hi FROM e"),
    "eval_multivalue": ('search index=events | eval parts = split(_raw, " "), n = mvcount(parts), second = mvindex(parts, 1) | table _id n second', _W + "SELECT _id, CAST(len(string_split(_raw, ' ')) AS INTEGER) AS n, string_split(_raw, ' ')[2] AS second FROM e"),
    "eval_time": ('search index=events | eval day = strftime(relative_time(_time, "-1d@d"), "%Y-%m-%d") | stats count by day', _W + "SELECT strftime(date_trunc('day', _time - INTERVAL 1 DAY), '%Y-%m-%d') AS day, count(*) AS count FROM e GROUP BY 1"),
    "eval_tonumber": ("search index=events | eval n = tonumber(k) | stats sum(n) AS total by source", _W + "SELECT source, sum(CAST(k AS DOUBLE)) AS total FROM e GROUP BY 1"),
    # fields out of text
    "rex": ('search index=events | rex "user_id=(?<uid>\\d+) k=(?<kk>\\d+)" | stats count by uid', _W + "SELECT regexp_extract(_raw, 'user_id=(\\d+) k=(\\d+)', 1) AS uid, count(*) AS count FROM e GROUP BY 1"),
    "kv_field": ("search index=main sourcetype=app_kv | stats count by logger", """WITH m AS (SELECT raw, fields, nullif(regexp_extract(raw, '(?s)^.*(?:^|[\\s,;({\\[|])logger=("[^"]*"|[^\\s,;]+)', 1), '') AS kv FROM wire_event WHERE sourcetype = 'app_kv')
SELECT coalesce(fields['logger'], CASE WHEN ltrim(raw) LIKE '{%' THEN json_extract_string(raw, '$.logger') ELSE trim(kv, '"') END) AS logger, count(*) AS count FROM m GROUP BY 1"""),
    "json_field": ("search index=events | where k >= 90 | stats count by k", _W + "SELECT k, count(*) AS count FROM e WHERE CAST(k AS INTEGER) >= 90 GROUP BY 1"),
}

Query = Callable[[SparkSession, str], DataFrame]


def _piped(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Compiler(catalog(spark, d)).compile(text)

    run.__doc__ = text
    return run


def _compat(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Compiler(catalog(spark, d), "compat").compile(text)

    run.__doc__ = text
    return run


def _timechart_pivot(spark, d):
    chart = Compiler(catalog(spark, d)).compile("search index=events | timechart span=1d count by source")
    got = wide(chart, "source", "count", ["click", "error"])
    return got.select(F.date_format("_time", "yyyy-MM-dd").alias("day"), F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("OTHER", F.lit(0)).alias("other"))


def _tokens(spark, d):
    return table(spark, d, "documents").filter("text is not null").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _index_stats(spark, d):
    """The statistics of every registered index."""
    e = catalog(spark, d).load(("*",))
    return e.groupBy("index").agg(F.count(F.lit(1)).alias("total_events"), F.coalesce(F.sum(F.octet_length("_raw")), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.countDistinct("host").alias("hosts"))


def _syslog_parse(spark, d):
    """The envelopes of all lines that have one, with a priority or without."""
    parts = syslog_fields(F.col("raw"))
    lines = table(spark, d, "wire_event").filter(has_envelope(F.col("raw")))
    return lines.select("delivery_id", *[parts[k].alias(k) for k in ("host", "source", "sourcetype", "severity")])


def _timestamp_extract(spark, d):
    """The instant written in each row's text."""
    rows = table(spark, d, "ingest_event").select("ingest_id", "raw", "host", "received_us")
    return normalise_written_times(rows, table(spark, d, "asset"), "raw", "host", "received_us").select("ingest_id", "written_us")


# Rules over what the test table holds.
WIRE_RULES = tuple(
    Rule(id, id, "", "medium", f"search index=main {search} | stats count by host")
    for id, search in (("refused", '"login refused"'), ("denied", '"was denied"'), ("dropped", "dropped packet"), ("slow", '(took OR "no answer")'), ("scan", "scan NOT ports"))
)


def _rules_single_scan(spark, d):
    return single_scan(catalog(spark, d), (*BUILTIN, *WIRE_RULES))


def _rule_failed_logins(spark, d):
    return Compiler(catalog(spark, d)).compile('search index=main ("login refused" OR "refused every third login") | stats count by host | where count >= 3')


def _notables_by_severity(spark, d):
    return notables.by_severity(table(spark, d, "notable"))


def _notable_latest(spark, d):
    return notables.latest_states(table(spark, d, "notable")).select("row_id", "id", "status")


def _notables_open(spark, d):
    return notables.latest_states(table(spark, d, "notable")).groupBy((F.col("status").isin(*notables.OPEN)).alias("is_open")).agg(F.count(F.lit(1)).alias("n"))


def _notable_page(spark, d):
    return notables.page(table(spark, d, "notable"), severity="high", limit=20, offset=10).select("row_id")


def _notables_capped(spark, d):
    return notables.capped(table(spark, d, "notable"), 100).select("row_id")


def _notables_throttled(spark, d):
    return notables.throttled(table(spark, d, "notable")).select("row_id")


def _risk_bands(spark, d):
    return enrich.risk(table(spark, d, "notable"))


def _severity_trend(spark, d):
    n = table(spark, d, "notable").filter("created_at is not null")
    return n.groupBy(F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd").alias("day"), notables.severity_key(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def _ioc_semi_join(spark, d):
    w = table(spark, d, "wire_event").select("delivery_id", F.try_element_at("fields", F.lit("src_ip")).alias("src_ip"))
    return enrich.with_matches(w, table(spark, d, "ioc"), "src_ip").select("delivery_id", "src_ip")


def _ioc_token_match(spark, d):
    return enrich.matches(table(spark, d, "wire_event"), table(spark, d, "ioc"), "delivery_id", "raw").groupBy("ioc_key").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def _asset_enrich(spark, d):
    w = table(spark, d, "wire_event").select("delivery_id", "host")
    return enrich.with_assets(w, table(spark, d, "asset"), columns=("asset_id", "criticality")).groupBy("criticality").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("asset_id").alias("assets"))


def _success_after_failures(spark, d):
    e = catalog(spark, d).load(("events",))
    got = enrich.success_after_failures(e, F.col("event_type") == "error", F.col("event_type") == "purchase", ["host"], within="1 hour", least=2)
    return got.select("_id", "n_refused")


def _customer_nation(spark, d):
    """Stars joined by declared keys; sides are broadcast by Spark's own size check."""
    c, n, r, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def _posting_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return t.agg(F.count_distinct("token").alias("term_count"), F.count(F.lit(1)).alias("total_postings"))


def _sourcetype_detect(spark, d):
    return table(spark, d, "wire_event").filter("source is not null").groupBy(sourcetype_of(F.col("source")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def _bytes_text(spark, d):
    return table(spark, d, "segment_meta").select("segment_id", bytes_text(F.col("size_bytes")).alias("size"))


def _timechart_filled(spark, d):
    chart = Compiler(catalog(spark, d)).compile("search index=events | timechart span=10m count")
    return filled(chart, "10m", "count").select(F.date_format("_time", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "count")


def _line_breaks(spark, d):
    lines = break_lines(table(spark, d, "documents").select("doc_id", "text"), "single", "text")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def _postings_search(spark, d):
    p = Postings(spark, scratch(spark, "postings"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("_raw"))
    p.build(docs)
    return p.search(docs, ["journal", "queue"]).select("_id")


def _stream_panes(spark, d):
    """Pane counts taken through a stream; the same as of the batch."""
    rows = table(spark, d, "ingest_event").select("ingest_id", "received_us", "timestamp_us", "index_name")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/ingest_event.parquet*")
    at, spec = scratch(spark, "stream"), PaneSpec()
    stated = micros_of_number(F.when(F.col("timestamp_us") != 0, F.col("timestamp_us")))
    start(stream, stated, F.col("received_us"), ["index_name"], spec, f"{at}/state", f"{at}/checkpoint", once=True).awaitTermination()
    store = PaneStore(spark, f"{at}/state", {"index_name": "string"}, spec)
    store.flush()  # the table ends, windows that wait for later receipts are emitted as they stand
    return store.current().select("index_name", F.col("window_us").alias("period_us"), "n")


def _line_breaks_multi(spark, d):
    return break_lines(table(spark, d, "documents").select("doc_id", "text"), "multi", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_events"))


def _line_breaks_auto(spark, d):
    return break_lines(table(spark, d, "documents").select("doc_id", "text"), "auto", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_events"))


def _line_breaks_json(spark, d):
    """Members of all findings' events as arrays of objects, broken again."""
    arrays = table(spark, d, "notable").select("row_id", F.to_json("contributing_events").alias("value"))
    return break_lines(arrays, "json").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_events"))


def _notable_events(spark, d):
    return notables.contributing(table(spark, d, "notable")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("row_id").alias("n_rows"))


# The same rules under each kind of condition.
CONDITIONS = ({"count_gt": 100}, {"count_ge": 1}, {"count_gt": 1_000_000_000}, {})


def _rules_fired(spark, d):
    """(rule_id, condition_no, fired) of every rule over the wire events under every condition."""
    c = catalog(spark, d)
    got = []
    for rule in WIRE_RULES:
        result = saved(Compiler(c).compile(rule.query), "rule")
        got += [(rule.id, k, met(result, condition)) for k, condition in enumerate(CONDITIONS)]
    return spark.createDataFrame(got, "rule_id string, condition_no int, fired boolean")


def _ingest_search(spark, d):
    """All ingest rows normalised, stored, found again by the engine and counted."""
    rows = table(spark, d, "ingest_event").select("raw", "host", "source", "sourcetype", F.col("index_name").alias("index"), "timestamp_us")
    engine = Engine(spark, scratch(spark, "store"))
    engine.store.append(normalise(rows))
    return engine.dataframe("search index=* | stats count by index, sourcetype")


def _host_names(spark, d):
    return table(spark, d, "wire_event").groupBy(host_key(F.col("host")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_LAST = "l AS (SELECT * FROM notable WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)"
_IOC = "i AS (SELECT nullif(lower(trim(ioc_value)), '') AS ioc_key, max(confidence) AS confidence FROM ioc WHERE nullif(lower(trim(ioc_value)), '') IS NOT NULL GROUP BY 1)"

OTHER: dict[str, tuple[Query, str | None]] = {
    "sort_lexical_compat": (_compat("search index=events | stats count by user_id | sort user_id | head 30"), _W + "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM e GROUP BY 1 ORDER BY 1 LIMIT 30"),
    "stats_compat": (
        _compat("search index=documents | stats count(lang) AS c, dc(lang) AS d, sum(n_chars) AS s by sourcetype"),
        "SELECT coalesce(doc_kind, '') AS sourcetype, count(*) AS c, count(DISTINCT coalesce(lang, '')) AS d, printf('%.6f', CAST(sum(n_chars) AS DOUBLE)) AS s FROM documents GROUP BY 1",
    ),
    "where_compat": (_compat('search index=events | where user_id > "5" | stats count by source'), _W + "SELECT source, count(*) AS count FROM e WHERE CAST(user_id AS VARCHAR) > '5' GROUP BY 1"),
    "timechart_pivot": (_timechart_pivot, _W + "SELECT strftime(_time, '%Y-%m-%d') AS day, CAST(count(*) FILTER (source = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (source = 'error') AS BIGINT) AS error, CAST(count(*) FILTER (source NOT IN ('click', 'error')) AS BIGINT) AS other FROM e GROUP BY 1"),
    "tokenize": (_tokens, f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1"),
    "posting_stats": (_posting_stats, f"SELECT count(DISTINCT token) AS term_count, count(*) AS total_postings FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS token FROM documents WHERE text IS NOT NULL)"),
    "index_stats": (
        _index_stats,
        _W + """SELECT 'events' AS index, count(*) AS total_events, CAST(coalesce(sum(strlen(_raw)), 0) AS BIGINT) AS total_size_bytes, count(DISTINCT host) AS hosts FROM e
UNION ALL SELECT 'documents', count(*), CAST(coalesce(sum(strlen(text)), 0) AS BIGINT), 0 FROM documents
UNION ALL SELECT 'main', count(*), CAST(coalesce(sum(strlen(raw)), 0) AS BIGINT), count(DISTINCT host) FROM wire_event
UNION ALL SELECT 'notable', count(*), CAST(coalesce(sum(strlen(description)), 0) AS BIGINT), count(DISTINCT host) FROM notable""",
    ),
    "syslog_parse": (_syslog_parse, written_sql.syslog(FACILITIES, SEVERITIES)),
    "timestamp_extract": (_timestamp_extract, written_sql.INGEST_WRITTEN),
    "sourcetype_detect": (
        _sourcetype_detect,
        """SELECT CASE WHEN regexp_matches(n, 'auth\\.log|^secure') THEN 'linux_secure' WHEN regexp_matches(n, 'syslog|^messages') THEN 'syslog' WHEN regexp_matches(n, 'access.*log|access_log') THEN 'access_combined'
WHEN regexp_matches(n, 'error.*log|error_log') THEN 'error_log' WHEN n LIKE '%.json' THEN 'json' WHEN n LIKE '%.csv' THEN 'csv' ELSE 'generic_single_line' END AS detected, count(*) AS n
FROM (SELECT lower(list_last(string_split(source, '/'))) AS n FROM wire_event WHERE source IS NOT NULL) GROUP BY 1""",
    ),
    "bytes_text": (_bytes_text, "SELECT segment_id, CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0::DOUBLE) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0::DOUBLE) WHEN size_bytes IS NOT NULL THEN printf('%.1f GB', size_bytes / 1073741824.0::DOUBLE) END AS size FROM segment_meta"),
    "timechart_filled": (
        _timechart_filled,
        _W + """, c AS (SELECT time_bucket(INTERVAL '10 minutes', _time) AS b, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 10 MINUTE)) AS b FROM c) SELECT strftime(r.b, '%Y-%m-%d %H:%M:%S') AS bucket, coalesce(n, 0) AS count FROM r LEFT JOIN c USING (b)""",
    ),
    "line_breaks": (_line_breaks, "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS l FROM documents WHERE text IS NOT NULL) WHERE trim(l) <> '' GROUP BY 1"),
    "line_breaks_multi": (
        _line_breaks_multi,
        r"""WITH l AS (SELECT doc_id, x, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, k, x[k] AS line, sum(CASE WHEN k = 1 OR NOT regexp_matches(x[k], '^[ \t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM l),
v AS (SELECT doc_id, e, string_agg(line, chr(10) ORDER BY k) AS event FROM g GROUP BY 1, 2) SELECT doc_id, count(*) AS n_events FROM v WHERE trim(event) <> '' GROUP BY 1""",
    ),
    "line_breaks_auto": (
        _line_breaks_auto,
        r"""WITH t AS (SELECT doc_id, regexp_matches(text, '\n[ \t]+\S') AS multi, regexp_split_to_array(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, multi, x, generate_subscripts(x, 1) AS k FROM t),
g AS (SELECT doc_id, k, x[k] AS line, sum(CASE WHEN k = 1 OR NOT multi OR NOT regexp_matches(x[k], '^[ \t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM l),
v AS (SELECT doc_id, e, string_agg(line, chr(10) ORDER BY k) AS event FROM g GROUP BY 1, 2) SELECT doc_id, count(*) AS n_events FROM v WHERE trim(event) <> '' GROUP BY 1""",
    ),
    "line_breaks_json": (_line_breaks_json, "SELECT row_id, CAST(len(contributing_events) AS BIGINT) AS n_events FROM notable WHERE len(contributing_events) > 0"),
    "notable_events": (
        _notable_events,
        """WITH e AS (SELECT row_id, unnest(contributing_events) AS e FROM notable), m AS (SELECT row_id, unnest(map_entries(e)) AS m FROM e)
SELECT m.key AS key, count(*) AS n, count(DISTINCT m.value) AS n_values, count(DISTINCT row_id) AS n_rows FROM m GROUP BY 1""",
    ),
    "rules_fired": (
        _rules_fired,
        f"""WITH w AS (SELECT host, lower(raw) AS r, {_TOKENS.replace('text', 'raw')} AS t FROM wire_event WHERE raw IS NOT NULL), c AS (SELECT host,
count(*) FILTER (r LIKE '%login refused%') AS refused, count(*) FILTER (r LIKE '%was denied%') AS denied, count(*) FILTER (list_contains(t, 'dropped') AND list_contains(t, 'packet')) AS dropped,
count(*) FILTER (list_contains(t, 'took') OR r LIKE '%no answer%') AS slow, count(*) FILTER (list_contains(t, 'scan') AND NOT list_contains(t, 'ports')) AS scan FROM w GROUP BY 1),
n AS (SELECT name, count(*) FILTER (n > 0) AS hosts, max(n) AS top FROM (UNPIVOT c ON refused, denied, dropped, slow, scan INTO NAME name VALUE n) GROUP BY 1)
SELECT name AS rule_id, CAST(k AS INTEGER) AS condition_no, CASE k WHEN 0 THEN greatest(hosts, top) > 100 WHEN 1 THEN greatest(hosts, top) >= 1 WHEN 2 THEN greatest(hosts, top) > 1000000000 ELSE hosts > 0 END AS fired FROM n, (VALUES (0), (1), (2), (3)) AS v(k)""",
    ),
    "ingest_search": (_ingest_search, "SELECT coalesce(nullif(index_name, ''), 'main') AS index, coalesce(nullif(sourcetype, ''), 'json') AS sourcetype, count(*) AS count FROM ingest_event GROUP BY 1, 2"),
    "postings_search": (_postings_search, f"SELECT doc_id AS _id FROM documents WHERE list_contains({_TOKENS}, 'journal') AND list_contains({_TOKENS}, 'queue')"),
    "stream_panes": (_stream_panes, "SELECT index_name, period_us, n FROM (" + core_sql["p1_hourly_counts"] + ") WHERE n > 0"),
    "host_names": (_host_names, f"SELECT {_HOST.format('host')} AS host, count(*) AS n FROM wire_event GROUP BY 1"),
    "rules_single_scan": (
        _rules_single_scan,
        f"""WITH w AS (SELECT host, lower(raw) AS r, {_TOKENS.replace('text', 'raw')} AS t FROM wire_event WHERE raw IS NOT NULL), c AS (SELECT host,
count(*) FILTER (r LIKE '%login refused%') AS refused, count(*) FILTER (r LIKE '%was denied%') AS denied, count(*) FILTER (list_contains(t, 'dropped') AND list_contains(t, 'packet')) AS dropped,
count(*) FILTER (list_contains(t, 'took') OR r LIKE '%no answer%') AS slow, count(*) FILTER (list_contains(t, 'scan') AND NOT list_contains(t, 'ports')) AS scan FROM w GROUP BY 1)
SELECT name AS rule_id, host, n FROM (UNPIVOT c ON refused, denied, dropped, slow, scan INTO NAME name VALUE n) WHERE n > 0""",
    ),
    "rule_failed_logins": (_rule_failed_logins, "SELECT host, count(*) AS count FROM wire_event WHERE lower(raw) LIKE '%login refused%' OR lower(raw) LIKE '%refused every third login%' GROUP BY 1 HAVING count(*) >= 3"),
    "notables_by_severity": (_notables_by_severity, "SELECT lower(trim(severity)) AS severity, count(*) AS n FROM notable GROUP BY 1"),
    "notable_latest": (_notable_latest, f"WITH {_LAST} SELECT row_id, id, status FROM l"),
    "notables_open": (_notables_open, f"WITH {_LAST} SELECT status IN ('new', 'in_progress') AS is_open, count(*) AS n FROM l GROUP BY 1"),
    "notable_page": (_notable_page, "SELECT row_id FROM notable WHERE lower(trim(severity)) = 'high' ORDER BY created_at DESC NULLS LAST, row_id DESC LIMIT 20 OFFSET 10"),
    "notables_capped": (_notables_capped, "SELECT row_id FROM notable ORDER BY row_id DESC LIMIT 100"),
    "notables_throttled": (_notables_throttled, "SELECT row_id FROM notable WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_id, host, epoch_us(created_at) // 3600000000 ORDER BY created_at, row_id) = 1"),
    "risk_bands": (_risk_bands, "SELECT entity, risk, n_rules, CASE WHEN risk > 75 THEN 'critical' WHEN risk > 50 THEN 'high' WHEN risk > 25 THEN 'medium' ELSE 'low' END AS band FROM (SELECT host AS entity, CAST(coalesce(sum(risk_score), 0) AS BIGINT) AS risk, count(DISTINCT rule_id) AS n_rules FROM notable WHERE host <> '' GROUP BY 1)"),
    "severity_trend": (_severity_trend, "SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, lower(trim(severity)) AS severity, count(*) AS n FROM notable WHERE created_at IS NOT NULL GROUP BY 1, 2"),
    "ioc_semi_join": (_ioc_semi_join, f"WITH {_IOC} SELECT delivery_id, fields['src_ip'] AS src_ip FROM wire_event WHERE nullif(lower(trim(fields['src_ip'])), '') IN (SELECT ioc_key FROM i)"),
    "ioc_token_match": (
        _ioc_token_match,
        f"WITH {_IOC}, t AS (SELECT delivery_id, unnest(list_distinct({_TOKENS.replace('text', 'raw')})) AS ioc_key FROM wire_event WHERE raw IS NOT NULL) SELECT ioc_key, count(*) AS n, max(confidence) AS confidence FROM t JOIN i USING (ioc_key) GROUP BY 1",
    ),
    "asset_enrich": (_asset_enrich, f"WITH a AS (SELECT {_HOST.format('hostname')} AS h, arg_min(criticality, asset_id) AS criticality, min(asset_id) AS asset_id FROM asset WHERE hostname IS NOT NULL GROUP BY 1) SELECT criticality, count(*) AS n, count(DISTINCT asset_id) AS assets FROM wire_event LEFT JOIN a ON h = {_HOST.format('host')} GROUP BY 1"),
    "success_after_failures": (_success_after_failures, _W + "SELECT s._id, CAST(count(*) AS INTEGER) AS n_refused FROM e s JOIN e b ON b.host = s.host AND b.event_type = 'error' AND b._time < s._time AND b._time >= s._time - INTERVAL 1 HOUR WHERE s.event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2"),
    "orders_by_nation": (_customer_nation, "SELECT r_name, n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
}

QUERIES: dict[str, Query] = {n: _piped(q) for n, (q, _) in PIPED.items()} | {n: q for n, (q, _) in OTHER.items()}
SQL: dict[str, str] = {n: s for n, (_, s) in PIPED.items()} | {n: s for n, (_, s) in OTHER.items() if s}
