"""Messages delivered more than once (problem 7): exactly one copy of each is kept.

Identifiers are split by their aggregated frequency.  What occurs once passes
where it lies, without a shuffle; only repeated groups are ranked, and both
results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.io import host_key, saved, small

#: Groups of at least so many copies are spread over all tasks.
HOT_COPIES = 100_000
#: 64-bit words of the filter that tells where a repeated identifier may be.  It is broadcast
#: and never has more rows than this, two numbers each.
WORDS = 1 << 20


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), host_key(F.col(host))), F.lit(""))


def _keyed(rows: DataFrame, seq: str, id_col: str, host: str) -> DataFrame:
    """(seq, k_id, k_host) of the rows that have an identifier; a null host equals null."""
    return rows.filter(F.col(id_col) != "").select(F.col(seq).alias("seq"), F.col(id_col).alias("k_id"), _host(host).alias("k_host"))


def _fingerprint(id: Column, host: Column) -> Column:
    return F.xxhash64(id, host)


def _word(fingerprint: Column) -> Column:
    return fingerprint.bitwiseAND(F.lit(WORDS - 1))


def _bit(fingerprint: Column) -> Column:
    return F.shiftrightunsigned(fingerprint, 58).cast("int")


def repeated_bits(fingerprints: DataFrame) -> DataFrame:
    """(word, bits) from the fingerprints (one row a message): a bit for each that
    occurs more than once.  Counted before the shuffle, so a group of any size is
    one row of each task."""
    counted = fingerprints.filter("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("fp")))
    return saved(counted.groupBy(_word(F.col("fp")).alias("__word")).agg(F.bit_or(bit).alias("__bits")), "repeated")


def _split(rows: DataFrame, fp: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose fingerprint (null where there is no identifier) surely occurs
    once, and the others.  The columns are kept."""
    marked = rows.withColumn("__fp", fp).withColumn("__word", _word(F.col("__fp"))).join(F.broadcast(bits), "__word", "left")
    one = F.lit(1).cast("bigint")
    maybe = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), _bit(F.col("__fp"))).bitwiseAND(one) == one, F.lit(False))
    gone = ("__fp", "__word", "__bits")
    return marked.filter(~maybe).drop(*gone), marked.filter(maybe).drop(*gone)


def frequencies(keyed: DataFrame) -> DataFrame:
    """(k_id, k_host, copies, first): identifiers by frequency, with the first copy."""
    return keyed.groupBy("k_id", "k_host").agg(F.count(F.lit(1)).alias("copies"), F.min("seq").alias("first"))


def ranked_copies(keyed: DataFrame, counted: DataFrame, hot_copies: int | None = None) -> DataFrame:
    """``keyed`` rows (of identifiers that may be repeated) with ``is_first``.

    Groups below ``hot_copies`` are ranked in a window.  Groups of that size and
    more are few (at most rows/hot_copies); what is first in them is looked up
    where their rows lie, so none of them is brought together.
    """
    hot_copies = hot_copies or HOT_COPIES
    hot = saved(counted.filter(F.col("copies") >= hot_copies), "hot")
    by_key = Window.partitionBy("k_id", "k_host")
    if hot.isEmpty():
        return keyed.withColumn("is_first", F.row_number().over(by_key.orderBy("seq")) == 1)
    keys = small(hot.select("k_id", "k_host", F.col("first").alias("__first")))
    spread = keyed.join(keys, ["k_id", "k_host"]).withColumn("is_first", F.col("seq") == F.col("__first")).drop("__first")
    rest = keyed.join(keys, ["k_id", "k_host"], "left_anti")
    return spread.unionByName(rest.withColumn("is_first", F.row_number().over(by_key.orderBy("seq")) == 1))


def _repeated(rows: DataFrame, seq: str, id_col: str, host: str) -> tuple[DataFrame, DataFrame]:
    """(bits, redundant): the filter of repeated identifiers, and (seq) of all copies but the first."""
    keyed = _keyed(rows, seq, id_col, host).filter("seq is not null")
    fp = _fingerprint(F.col("k_id"), F.col("k_host"))
    bits = repeated_bits(keyed.select(fp.alias("fp")))
    several = saved(_split(keyed, fp, bits)[1], "several")
    return bits, ranked_copies(several, frequencies(several)).filter("not is_first").select(F.col("seq").alias(seq))


def redundant(rows: DataFrame, seq: str = "delivery_id", id_col: str = "id", host: str = "host") -> DataFrame:
    """(seq): rows to leave out, all copies but the one with the least ``seq``.

    Copies have the same non-empty ``id_col`` and the same ``host`` as host names
    are compared; ``seq`` is unique, rows with a null ``seq`` are never left out.
    """
    return _repeated(rows, seq, id_col, host)[1]


def exactly_once(rows: DataFrame, seq: str = "delivery_id", id_col: str = "id", host: str = "host") -> DataFrame:
    """One copy of each message: singletons and rows without identifier as they
    are, of repeated ones the copy ranked first."""
    bits, left_out = _repeated(rows, seq, id_col, host)
    fp = F.when(F.col(id_col) != "", _fingerprint(F.col(id_col), _host(host)))
    single, several = _split(rows, fp, bits)
    return single.unionByName(several.join(left_out, seq, "left_anti").select(*rows.columns))


def new_messages(stored: DataFrame, arrived: DataFrame, id_col: str = "id", host: str = "host", seq: str = "delivery_id") -> DataFrame:
    """What of ``arrived`` must be appended to ``stored``: first copies of messages
    not stored yet (and all rows without identifier).

    The frequencies are those of stored and arrived messages together; of the
    stored ones only those that may have been delivered again are ranked, ahead of
    the arrived ones.
    """
    order = lambda new: F.struct(F.lit(new).alias("new"), F.col("seq").alias("seq"))
    every = [_keyed(t, seq, id_col, host).filter("seq is not null").withColumn("seq", order(new)) for new, t in ((0, stored), (1, arrived))]
    keyed = every[0].unionByName(every[1])
    fp = _fingerprint(F.col("k_id"), F.col("k_host"))
    bits = repeated_bits(keyed.select(fp.alias("fp")))
    several = saved(_split(keyed, fp, bits)[1], "several")
    left_out = ranked_copies(several, frequencies(several)).filter("not is_first and seq.new = 1").select(F.col("seq.seq").alias(seq))
    single, again = _split(arrived, F.when(F.col(id_col) != "", _fingerprint(F.col(id_col), _host(host))), bits)
    return single.unionByName(again.join(left_out, seq, "left_anti").select(*arrived.columns))
