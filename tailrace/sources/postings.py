"""A side table of postings (term, day, event) for searches of rare terms.

Worth it where a term occurs in few events: the semi-join then reads few rows
of the event table.  The table is sorted by term with a Parquet bloom filter,
so row groups without a term are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.functions.text import FOLD, tokens


class Postings:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, events: DataFrame, id_col: str = "_id", raw: str = "_raw") -> None:
        """Writes the postings of ``events``; null texts have none."""
        rows = events.select(F.col(id_col).alias("event_id"), F.explode(F.array_distinct(tokens(F.col(raw)))).alias("term"))
        ordered = rows.repartitionByRange("term", "event_id").sortWithinPartitions("term", "event_id")
        ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def ids(self, terms: list[str], every: bool = True) -> DataFrame:
        """(event_id) of the events that hold all (or any) of the terms; as in the index
        only A-Z are taken in any case."""
        low = list(dict.fromkeys(t.translate(FOLD) for t in terms))
        hits = self.read().filter(F.col("term").isin(low)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
        return hits.filter(F.col("n") == len(low) if every else F.col("n") >= 1).select("event_id")

    def search(self, events: DataFrame, terms: list[str], every: bool = True, id_col: str = "_id") -> DataFrame:
        ids = self.ids(terms, every)
        return events.join(ids, events[id_col] == ids["event_id"], "left_semi")

    def statistics(self) -> DataFrame:
        """(term_count, total_postings)."""
        return self.read().agg(F.count_distinct("term").alias("term_count"), F.count(F.lit(1)).alias("total_postings"))

    @staticmethod
    def union(tables: list[DataFrame]) -> DataFrame:
        """Postings of several tables as one, each posting once."""
        return reduce(DataFrame.unionByName, tables).distinct()
