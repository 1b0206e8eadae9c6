"""Every query that has SQL, on whole tables, and problem 2 against brute force."""

import pytest

from tailrace import queries as core
from tailrace.functions.loglines import parse_line
from tailrace.io import table
from tailrace.operators import entries
from tailrace.plans import queries as piped
from tests.oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
ALL = core.QUERIES | piped.QUERIES
SQL = core.SQL | piped.SQL


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(ALL[name](spark, str(DATA)), duck, SQL[name])


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


def test_p2_against_brute_force(spark):
    def host(h):
        h = None if h is None else h.strip(" ").lower()
        return h[:-1] if h and h.endswith(".") else h

    open_, entry = {}, {}
    rows = table(spark, str(DATA), "wire_event").collect()
    for r in sorted(rows, key=lambda r: (r.batch_id, r.batch_pos)):
        p = parse_line(r.raw)
        key = (r.batch_id, host(r.host), r.source)
        if p is None:
            continue
        if p.time is not None:
            open_[key] = r.delivery_id
            entry[r.delivery_id] = [r.delivery_id, p.level, p.component, r.fields is None]
        elif key in open_:
            entry[open_[key]][0] = r.delivery_id
    expect = {(k, last, level, writer) for k, (last, level, writer, bare) in entry.items() if bare}
    assert {tuple(r) for r in entries.found(table(spark, str(DATA), "wire_event")).collect()} == expect


def test_p2_entries_hold_every_row_once(spark):
    wire = table(spark, str(DATA), "wire_event")
    parsed = {r.delivery_id: parse_line(r.raw) for r in wire.select("delivery_id", "raw").collect()}
    got = core.QUERIES["p2_entries"](spark, str(DATA)).collect()
    entry = [r for r in got if r.lvl is not None]
    assert {r.delivery_id for r in entry} == {k for k, p in parsed.items() if p and p.time is not None} and len({r.delivery_id for r in got}) == len(got)
    # each row without a time is either by itself or in the message of an entry
    alone = {r.delivery_id: r.unparsed for r in got if r.lvl is None}
    rest = {k: p.unparsed for k, p in parsed.items() if p and p.time is None}
    assert rest and all(rest[k] == text for k, text in alone.items())
    first = sum(len(parsed[r.delivery_id].message or "") for r in entry)
    glued = [text for k, text in rest.items() if k not in alone]
    # every text brings a line break of its own, unless the first row has no message
    assert sum(len(r.message or "") for r in entry) - first in range(sum(map(len, glued)), sum(len(t) + 1 for t in glued) + 1)


def test_list_takes_every_event(spark):
    got = piped.QUERIES["stats_list_users"](spark, str(DATA)).collect()
    assert sum(r.kinds.count(",") + 1 for r in got) == table(spark, str(DATA), "events").filter("event_type is not null").count()


def test_index_statistics_cover_every_index(spark):
    got = piped.QUERIES["index_stats"](spark, str(DATA)).collect()
    assert sorted(r["index"] for r in got) == piped.catalog(spark, str(DATA)).names()
