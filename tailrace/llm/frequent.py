"""Most frequent items among billions (problem 6): iceberg queries by multi-hash filtering.

Pass 1 counts every value under several hashes into a fixed number of coarse
buckets; the counts are exact, so a bucket below the threshold holds no
frequent value.  Pass 2 keeps the values whose bucket reaches the threshold
under every hash and counts these exactly.  Memory is bounded by the buckets
of pass 1 and, in pass 2, by the survivors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.io import saved

#: Hashes, and buckets of each at least.
HASHES = 3
BUCKETS = 1 << 14
#: Buckets for each value that can be frequent: so many that most are light.
SPARE = 16


def n_buckets(share: float) -> int:
    """Buckets of a hash: at most 1/share of them can be heavy, so their number follows the share."""
    return max(BUCKETS, 1 << math.ceil(math.log2(SPARE / share)))


def _bucket(field: Column, item: Column, k: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), field, item), F.lit(buckets)).cast("int")


def long_form(rows: DataFrame, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """(field_name, item): one row for each non-empty value of each field."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("item")) for n, c in fields])
    return rows.select(F.explode(pairs).alias("p")).select("p.field_name", "p.item").filter(F.col("item") != "")


def bucket_counts(items: DataFrame, share: float = 0.01) -> DataFrame:
    """(field_name, hash_no, bucket, n): exact counts of coarse buckets.

    The counts of a task are summed before the shuffle: at most HASHES * n_buckets
    rows a field leave it, whatever the values are.
    """
    buckets = n_buckets(share)
    spread = F.array(*[F.struct(F.lit(k).alias("hash_no"), _bucket(F.col("field_name"), F.col("item"), k, buckets).alias("bucket")) for k in range(HASHES)])
    return items.select("field_name", F.explode(spread).alias("b")).groupBy("field_name", "b.hash_no", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(buckets: DataFrame, share: float, least: int) -> DataFrame:
    """(field_name, total, threshold): a value must occur ``share`` of the total and ``least`` times."""
    total = buckets.filter("hash_no = 0").groupBy("field_name").agg(F.sum("n").alias("total"))
    millionths = round(share * 1_000_000)
    enough = F.call_function("div", F.col("total") * millionths + 999_999, F.lit(1_000_000))
    return total.withColumn("threshold", F.greatest(enough, F.lit(least).cast("bigint")))


def heavy_buckets(buckets: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, hash_no, bucket) at or above the threshold.

    At most 1/share buckets of a hash can be: this side may be broadcast.
    """
    return buckets.join(F.broadcast(limits), "field_name").filter(F.col("n") >= F.col("threshold")).select("field_name", "hash_no", "bucket")


def frequent(items: DataFrame, buckets: DataFrame, share: float = 0.01, least: int = 5) -> DataFrame:
    """(field_name, item, n, total): values that make up at least ``share`` of their
    field and occur at least ``least`` times, with exact counts.

    ``buckets`` must be counted for the same ``share``.  ``items`` is read once more; values with a light bucket under any hash are
    dropped where they are read.  Fields without values have no rows.
    """
    limits = thresholds(buckets, share, least)
    heavy = heavy_buckets(buckets, limits)
    left = items
    for k in range(HASHES):
        of_k = F.broadcast(heavy.filter(F.col("hash_no") == k).select("field_name", F.col("bucket").alias("__b")))
        left = left.withColumn("__b", _bucket(F.col("field_name"), F.col("item"), k, n_buckets(share))).join(of_k, ["field_name", "__b"], "left_semi").drop("__b")
    return left.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(limits), "field_name").filter("n >= threshold").select("field_name", "item", "n", "total")


def wire_items(wire: DataFrame) -> DataFrame:
    """Values of host, fields.user and fields.src_ip as written."""
    return long_form(
        wire.select("host", F.try_element_at("fields", F.lit("user")).alias("u"), F.try_element_at("fields", F.lit("src_ip")).alias("s")),
        [("host", F.col("host")), ("fields.user", F.col("u")), ("fields.src_ip", F.col("s"))],
    )


def ioc_items(ioc: DataFrame) -> DataFrame:
    return long_form(ioc, [("ioc_value", F.col("ioc_value"))])


def top_values(wire: DataFrame, ioc: DataFrame, share: float = 0.01, least: int = 5) -> DataFrame:
    items = wire_items(wire).unionByName(ioc_items(ioc))
    return frequent(items, saved(bucket_counts(items, share), "buckets"), share, least)


def found(wire: DataFrame, ioc: DataFrame) -> DataFrame:
    return top_values(wire, ioc).select("field_name", "item")
