"""Problems 3, 6, 8, 9 and 10 against brute force, with nulls, ties, repeats, empty tables and long texts."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailrace.llm import distinct, frequent, leaks, packing, quality

WIRE = "received_at timestamp, index_name string, source string, host string, fields map<string,string>, day string, num long"


def wire(spark, data):
    return spark.createDataFrame([(t, i, s, h, f, "own", 1) for t, i, s, h, f in data], WIRE)


# --- problem 3 ---------------------------------------------------------------


def test_p3_counts_every_combination(spark):
    rnd = random.Random(1)
    t = datetime(2024, 3, 9, 12)
    data = [(t + timedelta(days=rnd.randrange(3)), rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), rnd.choice(["h1", " H1. ", "h2", None, "", *(f"p{k}" for k in range(150))]), None) for _ in range(600)]
    data += [(None, "a", "x", "h1", None), (t, "a", "only-null", None, None)]
    expect = defaultdict(set)
    for at, i, s, h, _ in data:
        key = h.strip().lower().removesuffix(".") if h else None
        if not key:
            continue
        d = at.date() if at else None
        for k in range(4):
            for kept in combinations(range(3), k):
                row = tuple(v if n in kept else None for n, v in enumerate((d, i, s)))
                expect[(*row, sum(1 << (2 - n) for n in range(3) if n not in kept))].add(key)
    got = distinct.host_counts(wire(spark, data)).collect()
    assert {(r.day, r.index_name, r.source, r.level): r.n_hosts for r in got} == {k: len(v) for k, v in expect.items()}
    assert {r.max_error for r in got} == {0}
    assert distinct.host_counts(wire(spark, [])).count() == 0


def test_p3_numbers_are_dense_and_partials_merge(spark):
    df = spark.range(1000).select((F.col("id") % 400).cast("string").alias("x"), F.col("id").alias("near"))
    coded = distinct.encode(df, "x", "near")
    assert sorted(r.num for r in coded.collect()) == list(range(400))
    pairs = df.join(coded, "x").withColumn("g", F.lit("g"))
    low, high = pairs.filter("near < 150"), pairs.filter("near >= 100 and near < 300")
    parts = [distinct.bitmaps(p, ["g"]) for p in (low, high)]
    assert distinct.counts(distinct.union(parts[0].unionByName(parts[1]), ["g"]), ["g"]).first().n_distinct == 300
    assert distinct.counts(distinct.intersection(*parts, ["g"]), ["g"]).first().n_distinct == 50


def test_p3_runs_with_one_dictionary_merge(spark, tmp_path):
    t = datetime(2024, 3, 9)
    runs = [wire(spark, [(t + timedelta(days=k), "a", "x", f"h{n}", None) for n in range(*r)]) for k, r in enumerate(((0, 2), (2, 4), (1, 3)))]
    hosts = distinct.Dictionary(spark, str(tmp_path / "hosts"))
    parts = [distinct.host_bitmaps(r, ["day", "index_name"], hosts) for r in runs]
    whole = distinct.counts(distinct.union(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["index_name"]), ["index_name"]).collect()
    assert [tuple(r) for r in whole] == [("a", 4, 0)]
    coded = hosts.read().collect()
    assert sorted(r.num for r in coded) == list(range(4)) and len({r.id for r in coded}) == 4
    # of two writers that start from one state the second numbers after the first
    other, new = distinct.Dictionary(spark, str(tmp_path / "hosts")), lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id string, near int")
    publish = hosts.commits.publish

    def late(number, content):
        hosts.commits.publish = publish
        other.update(new("p", "q"))
        publish(number, content)

    hosts.commits.publish = late
    coded = hosts.update(new("q", "r", None)).collect()
    assert sorted(r.num for r in coded) == list(range(7)) and len({r.id for r in coded}) == 7


def test_p3_buckets_and_cells(spark, monkeypatch):
    monkeypatch.setattr(distinct, "BUCKET_BITS", 7)
    monkeypatch.setattr(distinct, "CELL", 50)
    df = spark.range(1000).select(F.col("id").cast("string").alias("x"), (F.col("id") % 3).alias("near"), (F.col("id") % 7 < 3).cast("string").alias("g"))
    coded = distinct.encode(df, "x", "near")
    assert sorted(r.num for r in coded.collect()) == list(range(1000))
    maps = distinct.bitmaps(df.join(coded, "x"), ["g"])
    assert maps.filter("size(words) > 2").isEmpty() and maps.select("bucket").distinct().count() == 8
    assert {r.g: r.n_distinct for r in distinct.counts(maps, ["g"]).collect()} == {"true": 429, "false": 571}
    assert distinct.counts(distinct.union(maps, []), []).first().n_distinct == 1000


def test_p3_returning(spark):
    t = datetime(2024, 3, 9)
    data = [(t, "a", "x", "h1", None), (t, "a", "x", "h2", None), (t + timedelta(days=1), "a", "x", "H1", None), (t + timedelta(days=3), "a", "x", "h1", None)]
    assert sorted((r.day.day, r.n_hosts, r.n_returning) for r in distinct.returning_hosts(wire(spark, data)).collect()) == [(9, 2, 0), (10, 1, 1), (12, 1, 0)]


# --- problem 6 ---------------------------------------------------------------


@pytest.mark.parametrize("buckets", [frequent.BUCKETS, 4])
def test_p6_exactly_the_frequent_values(spark, monkeypatch, buckets):
    monkeypatch.setattr(frequent, "BUCKETS", buckets)
    rnd = random.Random(2)
    t = datetime(2024, 3, 9)
    data = [(t, None, None, rnd.choice(["hot", "hot", "warm", " Warm", None, "", f"x{k}"]), rnd.choice([None, {}, {"user": f"u{k % 90}"}, {"user": "", "src_ip": "1.1.1.1"}])) for k in range(3000)]
    ioc = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 4 + [None, ""]], "ioc_value string")
    found = defaultdict(Counter)
    for _, _, _, h, f in data:
        found["host"][h] += 1
        found["fields.user"][(f or {}).get("user")] += 1
        found["fields.src_ip"][(f or {}).get("src_ip")] += 1
    found["ioc_value"] = Counter({"a": 5, "b": 4})
    expect = set()
    for name, c in found.items():
        c.pop(None, None), c.pop("", None)
        total = sum(c.values())
        expect |= {(name, v, n, total) for v, n in c.items() if n * 100 >= total and n >= 5}
    assert {tuple(r) for r in frequent.top_values(wire(spark, data), ioc).collect()} == expect
    assert frequent.found(wire(spark, []), ioc.limit(0)).count() == 0


# --- problem 8 ---------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=120))
def test_p8_bins_hold_their_items(sizes):
    where, length = packing.best_fit(sizes)
    used = Counter()
    for b, s in zip(where, sizes):
        used[b] += s
    assert len(where) == len(sizes) and all(used[b] <= x for b, x in enumerate(length))
    assert all(length[b] == min(x for x in packing.LENGTHS if x >= u) for b, u in used.items())


def test_p8_little_room_is_left():
    rnd = random.Random(3)
    sizes = [min(2048, int(rnd.expovariate(1 / 200)) + 1) for _ in range(5000)]
    _, length = packing.best_fit(sizes)
    assert sum(length) <= 1.005 * sum(sizes)


def test_p8_counts_do_not_depend_on_the_pieces(monkeypatch):
    encoding = packing._encoding(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rnd = random.Random(5)
    texts = ["ab1" * 3000, "".join(rnd.choices(["word", " ", "  ", "\n", "\r\n", "'s", "é", "7", "...", "\t", "\x1c", "\xa0"], k=4000)), "x" * 5000 + " y"]
    for text in texts:
        whole = len(encoding.encode_ordinary(text))
        for size in (1, 7, 100, 6000):
            monkeypatch.setattr(packing, "PIECE_CHARS", size)
            assert packing._n_tokens(encoding, text) == whole


def test_p8_faults_are_seen(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 5), (3, 0), (4, 9)], "id long, n_tokens long")
    row = lambda *r: (*r,)
    schema = "doc_id long, piece int, n_tokens int, container string, container_tokens int, start int"
    good = spark.createDataFrame([row(1, 0, 10, "a", 15, 0), row(2, 0, 5, "a", 15, 10), row(4, 0, 9, "b", 9, 0)], schema)
    bad = spark.createDataFrame([row(1, 0, 9, "a", 12, 0), row(2, 0, 5, "a", 12, 8), row(9, 0, 1, "b", 4096, 0)], schema)
    assert [tuple(packing.faults(p, sizes).first()) for p in (good, bad, good.limit(0))] == [(3, 0, 0, 0, True), (3, 3, 2, 1, False), (3, 3, 0, 0, True)]


def test_p8_documents(spark):
    docs = spark.createDataFrame([(1, "one two three", 7), (2, None, 7), (3, "", 7), (4, "word " * 5000, 7), (5, "one two three", 7), (6, "a" * 300_000, 7)], "doc_id long, text string, size long")
    n = {r.id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert n[1] == n[5] == 3 and n[2] == n[3] == 0 and n[4] == 5001
    rows = packing.packed_documents(docs).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    assert {d: sum(r.n_tokens for r in x) for d, x in per.items()} == {d: k for d, k in n.items() if k}
    assert all(len(x) == -(-n[d] // 2048) for d, x in per.items())
    bins = defaultdict(list)
    for r in rows:
        bins[(r.container, r.container_tokens)].append(r)
    for (_, room), x in bins.items():
        x.sort(key=lambda r: r.start)
        assert [r.start for r in x] == [sum(y.n_tokens for y in x[:k]) for k in range(len(x))]
        assert sum(r.n_tokens for r in x) <= room <= 2048
    assert packing.packed_documents(docs.limit(0)).count() == 0


# --- problem 9 ---------------------------------------------------------------


def _brute(docs, items):
    grams = lambda t: {tuple(w[k : k + 12]) for w in [[x.lower() for x in re.findall(r"[^\W_]+", t or "")]] for k in range(len(w) - 11)}
    return {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}


def test_p9_passages_whole_or_in_part(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "2", "the"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 11, 12, 13, 40, 130])))) for i in range(30)] + [(100, None), (101, "")]
    docs = []
    for d in range(150):
        body = rnd.choices(vocabulary, k=rnd.randrange(200))
        if d % 3 == 0:
            w = rnd.choice(items)[1]
            w = (w or "").split()
            a = rnd.randrange(max(1, len(w) - 12))
            cut = w[a : a + rnd.choice([11, 12, 13, 30])]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [x.upper() + rnd.choice([",", ".\n", "-"]) for x in cut]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, " \n"), (902, "x_y" * 10), (903, "filler " * 30_000 + items[4][1] + " tail")]
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 64)
    got = leaks.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {tuple(r) for r in got.collect()} == _brute(docs, items)
    assert any(d == 903 for d, _ in _brute(docs, items)) == (len(items[4][1].split()) >= 12)


def test_p9_empty_and_report(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "s", "A, b. c d e f g h i j k L!"), (8, "s", "z")], "item_id long, suite string, item_text string")
    assert sorted(tuple(r) for r in leaks.leak_report(docs, items).collect()) == [(7, "s", 1), (8, "s", 0)]
    assert leaks.found(docs.limit(0), items).count() == 0 and leaks.found(docs, items.limit(0)).count() == 0
    c = leaks.candidates(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.doc_class, r.est_containment) for r in c] == [(1, 7, 3, 1.0)]


# --- problem 10 --------------------------------------------------------------

COMMON = frozenset("the of and to a in is was for it that on when who i we be as at by not".split())
PROSE = "When the queue was full, we moved the spool to another disk. It was late, and the team had to wait for the night shift.\nThe report was not easy to read."


def state(text):
    return quality.finish(quality.summarise(text, COMMON), COMMON)


def chunked(text, n):
    parts = [text[k : k + n] for k in range(0, len(text), n)] or [""]
    for k in range(len(parts) - 1):
        if parts[k].endswith("\r") and parts[k + 1].startswith("\n"):
            parts[k], parts[k + 1] = parts[k][:-1], "\r" + parts[k + 1]
    states = [quality.summarise(p, COMMON, k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
    while len(states) > 1:
        states = [states[k] if k + 1 == len(states) else quality.merge(quality.load(quality.dump(states[k])), states[k + 1], COMMON) for k in range(0, len(states), 2)]
    return quality.finish(states[0], COMMON)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\r\tabAé.,;|%4F`'Ã¤<>-=the", max_size=150), st.integers(1, 40))
def test_p10_chunks_give_the_same_counts(text, n):
    a, b = state(text), chunked(text, n)
    assert (a.lines, a.nonblank, a.ended, a.n_words, a.repeats) == (b.lines, b.nonblank, b.ended, b.n_words, b.repeats)
    assert a.total == b.total and a.mass == b.mass and a.count == b.count


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["x" * 301, "x" * 300 + "y", "<td " + "a" * 179 + ">", "</table>", "  ", "   ", " ", "\t", "\n", "\r\n", "Ã¤", "â€", "%F3", "%", "://", "|,", "the'", "-" * 150 + "the", "f0" * 20, "😀", "\x00", "ü", "-" * 40, "."]), max_size=14), st.integers(1, 400))
def test_p10_chunks_of_long_words_tags_and_blanks(bits, n):
    text = "".join(bits)
    a, b = state(text), chunked(text, n)
    assert (a.lines, a.nonblank, a.ended, a.n_words, a.repeats) == (b.lines, b.nonblank, b.ended, b.n_words, b.repeats)
    assert a.total == b.total and a.mass == b.mass and quality.stats_row(a) == quality.stats_row(b)


def test_p10_states_stay_small_and_cuts_are_whole():
    blob = "Zm9v" * 100_000
    pieces = list(quality.cut(blob + "\r\n" + blob, 50_000))
    assert "".join(pieces) == blob + "\r\n" + blob and max(map(len, pieces)) <= 50_000
    assert list(quality.cut("a\r\nb", 2)) == ["a", "\r\n", "b"] and list(quality.cut("\r\n\r\n", 1)) == ["\r\n", "\r\n"]
    states = [quality.summarise(p, COMMON, k == 0, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    for s in states[1:]:
        states[0] = quality.merge(states[0], s, COMMON)
    assert len(quality.dump(states[0])) < 3000
    assert quality.stats_row(quality.finish(states[0], COMMON)) == quality.stats_row(state(blob + "\r\n" + blob))


def test_p10_characters_are_counted_together():
    lines = ["", "a1 ü\t|;,`<%", "😀𝟘𐐀", "Ã" * 70_000, " "]
    got = quality._line_counts(lines)
    for line, c in zip(lines, got):
        assert c[:4] == [sum(map(str.isalpha, line)), sum(map(str.isspace, line)), sum(x in quality._VOWELS for x in line), sum(map(str.isdigit, line))]
        assert c[4:11] == [line.count(x) for x in "|\t;,`<%"]


def test_p10_chunks_of_realistic_texts():
    for text in (PROSE * 50, "| a | b |\r\n" * 200, "%F3%A6=87&" * 100, "  wide   gaps  here\n" * 80, "NÃ¤â€ x " * 90, "<td>x</td>" * 99, "one " * 500):
        for n in (7, 50, 333):
            a, b = state(text), chunked(text, n)
            assert a.total == b.total and a.mass == b.mass and quality.stats_row(a) == quality.stats_row(b)


@pytest.mark.parametrize(
    "text, shape",
    [
        (PROSE, "prose"),
        (PROSE.upper(), "prose"),
        ("- disk quota\n- night shift x2\n* port 5514 (done)\n  1) seal marker ?\n[ ] journal", "list"),
        ("queue depth\njournal severity\nowner\nreplay", "list"),
        ("| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |", "table"),
        ("a,b,c\n1,2,3\n4,5,6", "table"),
        ("zone                rule                bytes\nbuild-445           13                  2739", "table"),
        ("<table>\n<tr><td>x</td><td>y</td></tr>\n</table>", "table"),
        ("%F3%A6=879159&%A7%5F=910073&" * 9, "junk"),
        ("login " * 60, "junk"),
        ("click here " * 60, "junk"),
        ("00000000  d1 17 30 e2 0e 5c ac 5a 64 8e 0d af 93 f8 91 79\n" * 4, "junk"),
        ("RFsvtEujBNnQOKVcUb62h3QPnhx2B2VcgAsr32L8W4nya9NTl8oxOCOUukZctXTf\n" * 4, "junk"),
        ("odeyvlpzdnyt\nszdllmzcsrkklgwt\nrmcrbmltsn\npslrwjsyfrcjctnx\nzfrpntzkxxvvw\nzhzbflxgvh", "junk"),
        (PROSE + "\n\n| a | b |\n", "prose"),
        ("", ""),
        (" \n\t", ""),
    ],
)
def test_p10_shapes(text, shape):
    assert quality.shape_of(state(text)) == shape


def test_p10_over_a_table(spark, monkeypatch):
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    docs = spark.createDataFrame([(7, PROSE * 30, "s"), (7, "a " * 600, "s"), (1, PROSE, "s"), (2, None, "s"), (3, "", "s"), (4, "".join(f"- item{k} b\n" for k in range(400)), "s"), (5, PROSE * 40, "s"), (6, "".join(f"a{k}\r\nb\rc{k}\n" for k in range(100)), "s")], "doc_id long, text string, shape string")
    whole = sorted(tuple(r) for r in quality.document_statistics(docs, words).collect())
    assert [r[0] for r in whole] == [1, 3, 4, 5, 6, 7, 7]
    for chunk, fan in ((100, 2), (37, 16)):
        monkeypatch.setattr(quality, "FAN_IN", fan)
        assert sorted(tuple(r) for r in quality.statistics(docs, quality.common_words(words), chunk=chunk).collect()) == whole
    assert sorted(tuple(r) for r in quality.found(docs, words).collect()) == [(4, "list"), (6, "list"), (7, "junk")]
    assert quality.found(docs.limit(0), words).count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(quality, "MAX_COMMON", 3)
        quality.common_words(words)
