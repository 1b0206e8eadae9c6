"""Only new or changed records (problem 5): a Merkle tree over key ranges.

Records are cut into leaves by range of their key; a leaf's digest covers all
its records and versions, independent of their order, and an inner node's
digest its children.  A run compares its tree with the saved one from the root
down, follows only the nodes that differ, and takes the records of the changed
leaves.  Output and tree are published together by one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.io import Commits, hadoop, scratch

#: Keys of numbered feeds in one leaf; children of one inner node; levels above the leaves.
LEAF_WIDTH = 64
FANOUT = 512
LEVELS = 2
#: Leaves over the hash range of keys that are no numbers.
HASH_LEAVES = FANOUT**LEVELS
#: Versions whose records a tree may refer to; beyond, a run writes all records anew.
MOST_HOMES = 16

Levels = Callable[[int], DataFrame]


def records(df: DataFrame, feed: Column, key: Column, leaf: Column, content: list) -> DataFrame:
    """(feed, rec_key, leaf, digest) of each row with a feed and a key."""
    return df.select(feed.alias("feed"), key.cast("string").alias("rec_key"), leaf.cast("bigint").alias("leaf"), F.xxhash64(key.cast("string"), *content).alias("digest")).filter("feed is not null and rec_key is not null")


def number_leaf(n: Column) -> Column:
    return F.floor(n / F.lit(LEAF_WIDTH)).cast("bigint")


def hash_leaf(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HASH_LEAVES)).cast("bigint")


def leaves(rows: DataFrame) -> DataFrame:
    """(feed, leaf, n, digest): sums and exclusive ors of two hashes make up a leaf's
    digest; they are formed in parts before the shuffle.  Repeated rows count."""
    d = F.col("digest")
    whole = F.xxhash64(F.bit_xor(d), F.bit_xor(F.xxhash64(d)), F.sum(F.shiftright(d, 20)), F.count(F.lit(1)))
    return rows.groupBy("feed", "leaf").agg(F.count(F.lit(1)).alias("n"), whole.alias("digest"))


def _up(node: str) -> Column:
    return F.floor(F.col(node) / F.lit(FANOUT)).cast("bigint")


def level_up(nodes: DataFrame) -> DataFrame:
    """The parents of ``nodes`` (feed, leaf, n, digest)."""
    child = F.xxhash64(F.col("leaf"), F.col("digest"), F.col("n"))
    return (
        nodes.groupBy("feed", _up("leaf").alias("up"))
        .agg(F.sum("n").alias("n"), F.bit_xor(child).alias("x"), F.bit_xor(F.xxhash64(child)).alias("y"))
        .select("feed", F.col("up").alias("leaf"), "n", F.xxhash64("x", "y", "n").alias("digest"))
    )


def descend(now: Levels, was: Levels) -> DataFrame:
    """(feed, leaf): leaves that only one of two trees has, or with another digest.

    ``now(k)`` and ``was(k)`` give level k of a tree, 0 the leaves.  Below a node
    whose digests agree nothing is compared.
    """
    todo = None
    for level in range(LEVELS, -1, -1):
        a, b = (t(level).select("feed", "leaf", "n", "digest", F.lit(mine).alias("mine")) for t, mine in ((now, True), (was, False)))
        both = a.unionByName(b)
        if todo is not None:
            both = both.withColumn("up", _up("leaf")).join(todo, ["feed", "up"], "left_semi")
        of = lambda c, mine: F.max(F.when(F.col("mine") == mine, F.col(c)))
        paired = both.groupBy("feed", "leaf").agg(*[of(c, m).alias(f"{c}_{m}") for c in ("n", "digest") for m in (True, False)])
        same = F.col("n_True").eqNullSafe(F.col("n_False")) & F.col("digest_True").eqNullSafe(F.col("digest_False"))
        todo = paired.filter(~same).select("feed", F.col("leaf").alias("up"))
    return todo.select("feed", F.col("up").alias("leaf"))


def levels_of(bottom: DataFrame) -> Levels:
    """The levels above (feed, leaf, n, digest), made when asked for."""
    return lambda k: reduce(lambda nodes, _: level_up(nodes), range(k), bottom)


def changed_leaves(current: DataFrame, saved_leaves: DataFrame) -> DataFrame:
    """(feed, leaf): where the trees over two sets of leaves differ."""
    return descend(levels_of(current), levels_of(saved_leaves))


def _together(*jobs: Callable[[], None]) -> None:
    """Runs independent jobs side by side; the first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for f in [pool.submit(j) for j in jobs]:
            f.result()


class MerkleState:
    """Incremental runs over keyed records, kept below ``path``.

    A version holds the tree (all levels), the records of the leaves that it
    changed, its output and what was removed.  The tree names for each leaf the
    version that holds its records, so a run rewrites only what changed.  A
    version counts once it is committed under the next number, which one writer
    only can take: a run that fails before leaves no trace a reader would
    follow, of two runs from the same tree one fails, and a run that is
    repeated starts from the same saved tree.

    The rows of a run are written once and everything is derived from that
    snapshot: rows that arrive meanwhile belong to the next run.
    """

    NODE = "feed string, leaf bigint, n bigint, digest bigint, home bigint"
    RECORD = "feed string, rec_key string, leaf bigint, digest bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def version(self) -> tuple[int, str] | None:
        """(number, folder) of the newest version."""
        last = self.commits.last()
        return None if last is None else (last[0], last[1]["folder"])

    def _read(self, part: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{part}")

    def _levels(self, folder: str | None, part: str = "tree") -> Levels:
        """Levels of a saved tree; the leaves come with ``home`` from ``part``."""
        if folder is None:
            return lambda k: self.spark.createDataFrame([], self.NODE)

        def level(k: int) -> DataFrame:
            if k == 0 and part == "tree":
                return self._read(f"{folder}/tree", self.NODE)
            return self._read(f"{folder}/levels", f"{self.NODE}, level int").filter(F.col("level") == k).drop("level")

        return level

    def _write_levels(self, rows: DataFrame, folder: str, home: int | None) -> None:
        """All levels of the tree over ``rows``, in one job."""
        up = levels_of(leaves(rows))
        every = reduce(DataFrame.unionByName, [up(k).withColumn("level", F.lit(k)) for k in range(LEVELS + 1)])
        every.withColumn("home", F.lit(home).cast("bigint")).write.partitionBy("level").parquet(f"{self.path}/{folder}/levels")

    def saved_leaves(self) -> DataFrame:
        last = self.commits.last()
        return (self._levels(last[1]["folder"], last[1]["leaves"]) if last else self._levels(None))(0)

    def _saved_records(self, homes: dict[str, str], leaves_read: DataFrame) -> DataFrame:
        """Records of the saved leaves ``leaves_read`` (feed, leaf, home)."""
        parts = [self._read(f"{folder}/records", self.RECORD).withColumn("home", F.lit(int(n)).cast("bigint")) for n, folder in homes.items()]
        if not parts:
            return self.spark.createDataFrame([], self.RECORD)
        return reduce(DataFrame.unionByName, parts).join(leaves_read, ["feed", "leaf", "home"], "left_semi").drop("home")

    def seed(self, rows: DataFrame) -> None:
        """Takes ``rows`` as what earlier runs have processed, as the first version,
        which puts nothing out."""
        if self.version() is not None:
            raise ValueError("there is a version already")
        folder = f"{1:012d}-{uuid.uuid4().hex}"
        rows.select("feed", "rec_key", "leaf", "digest").write.parquet(f"{self.path}/{folder}/records")
        self._write_levels(self._read(f"{folder}/records", self.RECORD), folder, 1)
        self.commits.publish(1, {"folder": folder, "leaves": "levels", "homes": {"1": folder}})

    def run(self, rows: DataFrame, publish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Processes ``rows`` (feed, rec_key, leaf, digest and any more columns) and
        returns what was added or changed since the last version, each (feed,
        rec_key, digest) once, through ``publish`` if given."""
        last = self.commits.last()
        number, homes = (last[0] + 1, last[1]["homes"]) if last else (1, {})
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        rows.write.parquet(f"{at}/snapshot")
        rows = self.spark.read.schema(rows.schema).parquet(f"{at}/snapshot")
        was = self._levels(last[1]["folder"], last[1]["leaves"]) if last else self._levels(None)

        self._write_levels(rows, folder, None)
        now = self._levels(folder, "levels")
        descend(now, was).write.parquet(f"{at}/changed")
        changed = self._read(f"{folder}/changed", "feed string, leaf bigint")

        whole = len(homes) >= MOST_HOMES
        home = F.lit(number).cast("bigint")
        kept = was(0).select("feed", "leaf", F.col("home").alias("old")).join(changed, ["feed", "leaf"], "left_anti")
        if whole:
            kept = kept.limit(0)
        tree = now(0).drop("home").join(kept, ["feed", "leaf"], "left").select("feed", "leaf", "n", "digest", F.coalesce("old", home).alias("home"))
        touched = rows.join(changed, ["feed", "leaf"], "left_semi")
        before = self._saved_records(homes, was(0).join(changed, ["feed", "leaf"], "left_semi").select("feed", "leaf", "home"))
        due = touched.join(before.select("feed", "rec_key", "leaf", "digest"), ["feed", "leaf", "rec_key", "digest"], "left_anti").dropDuplicates(["feed", "rec_key", "digest"])
        gone = before.select("feed", "rec_key").distinct().join(touched.select("feed", "rec_key"), ["feed", "rec_key"], "left_anti")
        due = publish(due) if publish else due
        _together(
            lambda: tree.write.parquet(f"{at}/tree"),
            lambda: (rows if whole else touched).select("feed", "rec_key", "leaf", "digest").write.parquet(f"{at}/records"),
            lambda: due.write.parquet(f"{at}/output"),
            lambda: gone.write.parquet(f"{at}/removed"),
        )
        self.commits.publish(number, {"folder": folder, "leaves": "tree", "homes": {str(number): folder} if whole else homes | {str(number): folder}})
        for part in ("snapshot", "levels/level=0", "changed"):
            path, fs = hadoop(self.spark, f"{at}/{part}")
            fs.delete(path, True)
        return self.output()

    def output(self) -> DataFrame:
        """What the newest version put out; nothing before the first run."""
        last = self.commits.last()
        if last is None or last[1]["leaves"] == "levels":
            return self.spark.createDataFrame([], self.RECORD)
        return self._read(f"{last[1]['folder']}/output")

    def removed(self) -> DataFrame:
        """(feed, rec_key) of the keys that the newest version no longer found."""
        last = self.commits.last()
        if last is None or last[1]["leaves"] == "levels":
            return self.spark.createDataFrame([], "feed string, rec_key string")
        return self._read(f"{last[1]['folder']}/removed", "feed string, rec_key string")

    def vacuum(self) -> int:
        """Deletes folders that the newest version doesn't refer to, those of failed
        runs included; returns how many.  No run may be under way."""
        last = self.commits.last()
        keep = set() if last is None else {last[1]["folder"], *last[1]["homes"].values()}
        at, fs = hadoop(self.spark, self.path)
        n = 0
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name[:12].isdigit() and name not in keep:
                fs.delete(s.getPath(), True)
                n += 1
        return n


def feed_marks(run_log: DataFrame) -> DataFrame:
    """(feed, mark): what the committed, successful runs of each feed reached."""
    return run_log.filter("status = 'succeeded' and committed_at is not null").groupBy("feed").agg(F.max("to_mark").alias("mark")).filter("mark is not null and feed is not null")


def feed_records(wal: DataFrame, notable: DataFrame) -> DataFrame:
    """(feed, rec_key, leaf, at, digest): numbers of a wal file, and states of a finding
    by the later of their times.  Null numbers and ids are no records."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    of_wal = wal.filter("wal_file is not null and sequence_number is not null").select(
        F.col("wal_file").alias("feed"), F.col("sequence_number").cast("string").alias("rec_key"), number_leaf(F.col("sequence_number")).alias("leaf"), F.col("sequence_number").cast("bigint").alias("at")
    )
    of_notable = notable.filter("id is not null").select(
        F.lit("notable").alias("feed"), F.col("id").alias("rec_key"), hash_leaf(F.col("id")).alias("leaf"), F.greatest(micros("created_at"), micros("updated_at")).alias("at")
    )
    return of_wal.unionByName(of_notable).withColumn("digest", F.xxhash64("rec_key", "at"))


def found(wal: DataFrame, notable: DataFrame, run_log: DataFrame, path: str | None = None) -> DataFrame:
    """(feed, rec_key): what the next run over each feed has to process, each record once.

    It is the output of a run of :class:`MerkleState` at ``path``: the tree is
    compared with the saved one, and records of changed leaves that these leaves
    didn't hold before are put out.  The run log holds marks but no trees, so
    where ``path`` has no version yet (or none is given) the saved tree is first
    made of the records up to the marks, which is what the logged runs have seen.
    """
    spark = wal.sparkSession
    rows = feed_records(wal, notable)
    state = MerkleState(spark, path or scratch(spark, "merkle"))
    if state.version() is None:
        marks = feed_marks(run_log)
        # a record without a time is not past any mark
        seen = rows.join(marks, "feed").filter(~F.coalesce(F.col("at") > F.col("mark"), F.lit(False))).drop("mark")
        state.seed(seen)
    return state.run(rows).select("feed", "rec_key").distinct()
