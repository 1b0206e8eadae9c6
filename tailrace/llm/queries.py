"""Queries over the test tables, by problem: training-data part, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailrace.io import saved, scratch, table
from tailrace.llm import distinct, frequent, leaks, packing, quality


def _p3_distinct_hosts(spark, d):
    return distinct.host_counts(table(spark, d, "wire_event")).withColumn("day", F.col("day").cast("string"))


def _p3_returning_hosts(spark, d):
    return distinct.returning_hosts(table(spark, d, "wire_event")).withColumn("day", F.col("day").cast("string"))


def _p3_merged_days(spark, d):
    """Distinct hosts by index and source from two runs, over the earlier and the later days."""
    wire = table(spark, d, "wire_event")
    day = F.to_date(F.col("received_at").cast("timestamp"))
    middle = wire.agg(F.date_add(F.min(day), F.call_function("div", F.datediff(F.max(day), F.min(day)), F.lit(2)).cast("int")).alias("m")).first().m
    early = F.coalesce(day <= F.lit(middle), F.lit(False))
    dictionary = distinct.Dictionary(spark, scratch(spark, "hosts"))
    return distinct.merged_runs([wire.filter(early), wire.filter(~early)], ["day", "index_name", "source"], ["index_name", "source"], dictionary)


def _p6_found(spark, d):
    return frequent.found(table(spark, d, "wire_event"), table(spark, d, "ioc"))


def _p6_counts(spark, d):
    return frequent.top_values(table(spark, d, "wire_event"), table(spark, d, "ioc"))


def _p8_packed(spark, d):
    return packing.packed_documents(table(spark, d, "documents"))


def _p8_faults(spark, d):
    """What may go wrong in a packing, counted over all documents."""
    docs = table(spark, d, "documents")
    return packing.faults(saved(packing.packed_documents(docs), "packed"), packing.token_counts(docs))


def _p9_found(spark, d):
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p9_leak_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p10_found(spark, d):
    return quality.found(table(spark, d, "documents"), table(spark, d, "common_word"))


def _p10_statistics(spark, d):
    got = quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_word"))
    return got.select("doc_id", "n_chars", "n_words", "n_lines", "mean_word_length")


def _p10_ratios(spark, d):
    got = quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_word"))
    return got.select("doc_id", "symbol_ratio", "digit_ratio", "punctuated_line_share", "common_word_share")


def _p10_labels(spark, d):
    """The shapes found for the labelled documents."""
    got = quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_word"))
    return got.join(table(spark, d, "doc_label").select("doc_id"), "doc_id", "left_semi").select("doc_id", "shape")


QUERIES = {
    "p3_distinct_hosts": _p3_distinct_hosts,
    "p3_returning_hosts": _p3_returning_hosts,
    "p3_merged_days": _p3_merged_days,
    "p6_found": _p6_found,
    "p6_counts": _p6_counts,
    "p8_packed": _p8_packed,
    "p8_faults": _p8_faults,
    "p9_found": _p9_found,
    "p9_leak_report": _p9_leak_report,
    "p10_found": _p10_found,
    "p10_statistics": _p10_statistics,
    "p10_ratios": _p10_ratios,
    "p10_labels": _p10_labels,
}

_HOST = r"nullif(regexp_replace(lower(trim(host)), '\.$', ''), '')"
_VALUES = """v AS (SELECT 'host' AS field_name, host AS item FROM wire_event UNION ALL SELECT 'fields.user', fields['user'] FROM wire_event
UNION ALL SELECT 'fields.src_ip', fields['src_ip'] FROM wire_event UNION ALL SELECT 'ioc_value', ioc_value FROM ioc),
n AS (SELECT * FROM v WHERE item <> ''), t AS (SELECT field_name, count(*) AS total FROM n GROUP BY 1), k AS (SELECT field_name, item, count(*) AS n FROM n GROUP BY 1, 2)"""
_GRAMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents WHERE text IS NOT NULL),
u AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS x FROM eval_item WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(x[k : k + 11], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, len(x) - 10)) AS k FROM w)),
ig AS (SELECT item_id, array_to_string(x[k : k + 11], ' ') AS g FROM (SELECT item_id, x, unnest(range(1, len(x) - 10)) AS k FROM u)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CORE = r"regexp_extract(x, '[\p{L}\p{N}](?:.*[\p{L}\p{N}])?')"

SQL = {
    "p3_distinct_hosts": f"""WITH w AS (SELECT CAST(received_at AS DATE) AS day, index_name, source, {_HOST} AS h FROM wire_event)
SELECT CAST(w.day AS VARCHAR) AS day, index_name, source, CAST(grouping(w.day, index_name, source) AS INTEGER) AS level, CAST(count(DISTINCT h) AS BIGINT) AS n_hosts, CAST(0 AS BIGINT) AS max_error
FROM w GROUP BY CUBE (w.day, index_name, source) HAVING count(h) > 0""",
    "p3_returning_hosts": f"""WITH w AS (SELECT DISTINCT CAST(received_at AS DATE) AS day, {_HOST} AS h FROM wire_event WHERE {_HOST} IS NOT NULL)
SELECT CAST(w.day AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n_hosts, CAST(count(y.h) AS BIGINT) AS n_returning FROM w LEFT JOIN w y ON y.h = w.h AND y.day = w.day - 1 GROUP BY w.day""",
    "p3_merged_days": f"""SELECT index_name, source, CAST(count(DISTINCT {_HOST}) AS BIGINT) AS n_hosts, CAST(0 AS BIGINT) AS max_error FROM wire_event GROUP BY 1, 2 HAVING count({_HOST}) > 0""",
    "p6_found": f"WITH {_VALUES} SELECT field_name, item FROM k JOIN t USING (field_name) WHERE n >= 5 AND n * 100 >= total",
    "p6_counts": f"WITH {_VALUES} SELECT field_name, item, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM k JOIN t USING (field_name) WHERE n >= 5 AND n * 100 >= total",
    "p9_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM f",
    "p9_leak_report": f"WITH {_GRAMS} SELECT e.item_id, suite, CAST(count(f.doc_id) AS BIGINT) AS n_docs FROM eval_item e LEFT JOIN f USING (item_id) GROUP BY 1, 2",
    "p8_faults": "SELECT CAST(count(*) FILTER (text <> '') AS BIGINT) AS n_items, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_misplaced, true AS well_filled FROM documents",
    "p10_labels": "SELECT doc_id, shape FROM doc_label",
    "p10_ratios": rf"""WITH d AS (SELECT doc_id, text, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS solid FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, length(regexp_replace(text, '[{_SPACE}\p{{L}}\p{{Nd}}²³¹]', '', 'g')) AS symbols, len(regexp_extract_all(text, '[\p{{Nd}}²³¹]')) AS digits, solid FROM d),
l AS (SELECT doc_id, count(*) FILTER (regexp_matches(l, '[^{_SPACE}]')) AS lines,
count(*) FILTER (regexp_matches(l, '[^ ][.!?…。！？]["''”’»)\]*_`]*[{_SPACE}]*$')) AS ended FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS l FROM d) GROUP BY 1),
k AS (SELECT DISTINCT lower(word) AS w FROM common_word WHERE word IS NOT NULL),
w AS (SELECT doc_id, lower({_CORE}) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS x FROM d)),
c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (c IN (SELECT w FROM k) OR (contains(c, chr(39)) AND split_part(c, chr(39), 1) IN (SELECT w FROM k))) AS common FROM w GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.solid = 0 THEN 0.0 ELSE symbols / d.solid::DOUBLE END AS symbol_ratio, CASE WHEN d.solid = 0 THEN 0.0 ELSE digits / d.solid::DOUBLE END AS digit_ratio,
CASE WHEN lines > 0 THEN ended / lines::DOUBLE ELSE 0.0 END AS punctuated_line_share, coalesce(common / words::DOUBLE, 0.0) AS common_word_share
FROM d JOIN s USING (doc_id) JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "p10_statistics": rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(text) - CAST(len(regexp_extract_all(text, '\r\n')) AS BIGINT) * 2 - len(regexp_extract_all(replace(text, chr(13) || chr(10), ''), '[\r\n]')) AS BIGINT) AS n_chars,
CAST(len(x) AS BIGINT) AS n_words, CAST(len(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda l: regexp_matches(l, '[^{_SPACE}]'))) AS BIGINT) AS n_lines,
CASE WHEN len(x) = 0 THEN 0.0 ELSE list_sum(list_transform(x, lambda y: length(y))) / len(x)::DOUBLE END AS mean_word_length FROM w""",
}
