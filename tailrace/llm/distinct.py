"""Distinct counts over huge identifier sets (problem 3), exact and mergeable.

Identifiers are encoded as dense integers by a dictionary that is kept and only
grows, so numbers mean the same in every run.  The set of a group is a
compressed bitmap in buckets: one row for each (group, bucket) with the
bucket's non-zero 64-bit words.  Rows of several runs are put together by
or-ing the words of equal groups and buckets, sets are intersected by and-ing
them, a count is the sum of the bits, and the error is zero.  A bucket covers
BUCKET numbers, which bounds what one row and one key of a shuffle may hold,
however large a group is.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailrace.io import Commits, Taken, hadoop, host_key, saved, scratch, small

#: Numbers of a bucket: 2 to this power.
BUCKET_BITS = 20
#: Identifiers that are numbered together by one task, about.
CELL = 100_000
#: Folders of a dictionary that are read side by side before they are written into one.
MOST_PARTS = 16


class Dictionary:
    """identifier -> dense number, kept below ``path`` and only added to.

    A state is a numbered commit that names the folders of the table and the next
    free number; one writer only can take a commit number, and one that comes
    second starts again from the state of the first, so no number and no
    identifier is given twice.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"id {kind}, num bigint"
        self.commits = Commits(spark, f"{self.path}/commits")

    def _table(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        """(id, num)."""
        last = self.commits.last()
        return self._table(last[1]["parts"] if last else [])

    def update(self, seen: DataFrame) -> DataFrame:
        """Numbers what is new in ``seen`` (id, near) after the last number; returns the table.

        Identifiers first seen together (least ``near``) get neighbouring numbers,
        so the bitmaps of short-lived identifiers fill few words.  Numbers are ranks
        within a (near, hash range) cell plus the size of the cells before it; there
        are so many ranges that a cell has about CELL identifiers at most.
        """
        firsts = saved(seen.filter("id is not null").groupBy("id").agg(F.min("near").alias("near")), "seen")
        while True:
            last = self.commits.last()
            number, parts, start = (last[0] + 1, last[1]["parts"], last[1]["next"]) if last else (1, [], 0)
            new = firsts.join(self._table(parts), "id", "left_anti") if parts else firsts
            new = saved(new, "new") if parts else new
            n = new.count()
            if n == 0:
                return self._table(parts)
            new = new.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(-(-n // CELL))).cast("int"))
            # one row a cell, not an identifier: the running sum is over cells
            sizes = new.groupBy("near", "range").agg(F.count(F.lit(1)).alias("k"))
            before = F.coalesce(F.sum("k").over(Window.orderBy("near", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            starts = small(sizes.select(F.col("near").alias("c_near"), F.col("range").alias("c_range"), before.alias("start")))
            ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("near", "range").orderBy("id")) - 1)
            coded = ranked.join(starts, F.col("near").eqNullSafe(F.col("c_near")) & (F.col("range") == F.col("c_range"))).select("id", (F.col("start") + F.col("rank") + start).alias("num"))
            if len(parts) >= MOST_PARTS:
                coded, parts = self._table(parts).unionByName(coded), []
            name = f"part-{number:012d}-{uuid.uuid4().hex}"
            coded.write.parquet(f"{self.path}/{name}")
            try:
                self.commits.publish(number, {"parts": [*parts, name], "next": start + n})
            except Taken:
                at, fs = hadoop(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)
                continue
            return self._table([*parts, name])


def encode(pairs: DataFrame, id_col: str, near: str, dictionary: Dictionary | None = None) -> DataFrame:
    """(id_col, num): the number of each distinct identifier, by ``dictionary`` or,
    if none is given, one made for these rows."""
    if dictionary is None:
        dictionary = Dictionary(pairs.sparkSession, scratch(pairs.sparkSession, "dictionary"), dict(pairs.dtypes)[id_col])
    return dictionary.update(pairs.select(F.col(id_col).alias("id"), F.col(near).alias("near"))).withColumnRenamed("id", id_col)


def _places(num: Column) -> list[Column]:
    """bucket, word and bit of a number."""
    word = F.shiftright(num, 6).bitwiseAND(F.lit((1 << BUCKET_BITS - 6) - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), num.bitwiseAND(F.lit(63)).cast("int"))
    return [F.shiftright(num, BUCKET_BITS).alias("bucket"), word.alias("word"), bit.alias("bits")]


def _merged(words: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, bucket, word, bits): words of finer groups or of several runs, or-ed."""
    return words.groupBy(*groups, "bucket", "word").agg(F.bit_or("bits").alias("bits"))


def _packed(words: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, bucket, words): at most 2**(BUCKET_BITS - 6) words in a row."""
    return words.groupBy(*groups, "bucket").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _words(maps: DataFrame, groups: list[str]) -> DataFrame:
    return maps.select(*groups, "bucket", F.inline("words"))


def bitmaps(pairs: DataFrame, groups: list[str], num: str = "num") -> DataFrame:
    """(groups, bucket, words): the set of each group as a compressed bitmap.

    ``pairs`` are shuffled once, by group and bucket."""
    placed = pairs.select(*groups, *_places(F.col(num))).repartition(*groups, "bucket")
    return _packed(_merged(placed, groups), groups)


def union(maps: DataFrame, groups: list[str]) -> DataFrame:
    """Bitmaps of several runs that used one dictionary, or of finer groups, or-ed to ``groups``."""
    return _packed(_merged(_words(maps, groups), groups), groups)


def intersection(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Bitmaps of what both sides hold, by ``groups``."""
    r = _words(right, groups).withColumnRenamed("bits", "__r")
    both = _words(left, groups).join(r, [*groups, "bucket", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("__r"))).drop("__r")
    return _packed(both.filter("bits <> 0"), groups)


def _counted(words: DataFrame, groups: list[str], name: str, bits: Column) -> DataFrame:
    got = words.groupBy(*groups).agg(F.sum(bits).cast("bigint").alias(name)).filter(F.col(name) > 0)
    return got.withColumn("max_error", F.lit(0).cast("bigint"))


def counts(maps: DataFrame, groups: list[str], name: str = "n_distinct") -> DataFrame:
    """(groups, name, max_error): bits of each group, whose rows must be merged
    (see :func:`union`); the error bound is 0.  Empty sets have no row."""
    return _counted(maps, groups, name, F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"])))


def host_pairs(wire: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct (dims, host), dims out of day, index_name and source; null hosts are no names."""
    day = F.to_date(F.col("received_at").cast("timestamp")).alias("day")
    return wire.select(*[day if d == "day" else d for d in dims], F.nullif(host_key(F.col("host")), F.lit("")).alias("host")).filter("host is not null").distinct()


def host_bitmaps(wire: DataFrame, dims: list[str], dictionary: Dictionary) -> DataFrame:
    """(dims, bucket, words): a partial result of one run over ``wire``, which can be
    put together with those of other runs that used ``dictionary``."""
    pairs = saved(host_pairs(wire, dims), "pairs")
    return saved(bitmaps(pairs.join(encode(pairs, "host", dims[0], dictionary), "host"), dims), "bitmaps")


def host_counts(wire: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """(day, index_name, source, level, n_hosts, max_error): distinct hosts of each day,
    and of each combination of day, index and source.

    ``level`` is the grouping number (bits day, index, source; 1 = all values
    together, the column is then null).  Words are shuffled by source and bucket
    once, which serves all four combinations with the source; the others are
    rolled up from the finest, each from the smallest that holds it.
    """
    dims = ["day", "index_name", "source"]
    pairs = saved(host_pairs(wire, dims), "pairs")
    numbered = pairs.join(encode(pairs, "host", "day", dictionary), "host")
    finest = _merged(numbered.select(*dims, *_places(F.col("num"))).repartition("source", "bucket"), dims)
    of = {tuple(dims): finest}
    made_from = {
        ("day", "source"): tuple(dims), ("index_name", "source"): tuple(dims), ("source",): ("index_name", "source"),
        ("day", "index_name"): tuple(dims), ("day",): ("day", "index_name"), ("index_name",): ("day", "index_name"), (): ("index_name",),
    }
    for kept, finer in made_from.items():
        of[kept] = _merged(of[finer], list(kept))
    types = dict(pairs.dtypes)
    parts = []
    for kept in sorted((k for n in range(4) for k in combinations(dims, n)), key=len):
        level = sum(1 << (2 - k) for k, d in enumerate(dims) if d not in kept)
        got = _counted(of[kept], list(kept), "n_hosts", F.bit_count("bits"))
        parts.append(got.select(*[(F.col(d) if d in kept else F.lit(None).cast(types[d])).alias(d) for d in dims], F.lit(level).alias("level"), "n_hosts", "max_error"))
    return reduce(DataFrame.unionByName, parts)


def merged_runs(runs: list[DataFrame], dims: list[str], groups: list[str], dictionary: Dictionary) -> DataFrame:
    """(groups, n_hosts, max_error): distinct hosts by ``groups`` from partial results by
    ``dims``, one made by each of ``runs`` (parts of the rows) on its own."""
    maps = reduce(DataFrame.unionByName, [host_bitmaps(r, dims, dictionary) for r in runs])
    return counts(union(maps, groups), groups, "n_hosts")


def returning_hosts(wire: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """(day, n_hosts, n_returning): hosts of each day, and those of them seen the day before."""
    spark = wire.sparkSession
    daily = host_bitmaps(wire, ["day"], dictionary or Dictionary(spark, scratch(spark, "dictionary")))
    moved = daily.withColumn("day", F.date_add("day", 1))
    again = counts(intersection(daily, moved, ["day"]), ["day"], "n_returning").drop("max_error")
    return counts(daily, ["day"], "n_hosts").drop("max_error").join(again, "day", "left").withColumn("n_returning", F.coalesce("n_returning", F.lit(0)))
