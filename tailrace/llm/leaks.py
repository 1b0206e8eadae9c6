"""Evaluation texts leaking into training text (problem 9): size-partitioned MinHash containment search.

A document that holds PASSAGE consecutive words of an item holds all of the
passage's five-word shingles.  The shingles of an item are cut into stretches
such that every passage of the item covers at least one whole stretch, and the
MinHash (the least hash) of each stretch makes up the item's signature.  So a
document with a passage has at least one hash of the signature among its own
shingles: the containment of the signature in the document is at least one over
the number of its hashes, and no pair is lost.

Items are partitioned by size, because that number is a matter of size.  The
shortest class has one hash, that of the shingles which all passages of so
short an item share, so its whole signature must be contained; a longer class
has one for every four shingles and a lower threshold.  Each class is an index
of its own.  Whole-text MinHashes would find a dozen words inside a document of
thousands only by chance.

Candidates are verified where they are found, word by word around the shared
shingle, so neither texts nor hashes of documents are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

PASSAGE = 12
SHINGLE = 5
#: Shingles of a passage; of a stretch, so that a passage at any place covers a whole one.
SPAN = PASSAGE - SHINGLE + 1
STRETCH = SPAN // 2
#: Size class of items whose passages all share some shingles.
SHORT = 3
#: Words that are hashed at once.
BLOCK_WORDS = 200_000
#: Bytes of item text that are held by each worker at once; more items are searched in blocks,
#: with one pass over the documents for each.
BLOCK_BYTES = 16 * 1024 * 1024

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


class _Hashes(dict):
    """Word in any case -> 64-bit hash; emptied when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word.lower().encode())
        if len(word) <= 64:
            self[word] = h
        return h


_hash_of = _Hashes()


def shingle_hashes(tokens: list[str]) -> np.ndarray:
    """A hash of every SHINGLE consecutive words."""
    h = np.fromiter(map(_hash_of.__getitem__, tokens), np.uint64, len(tokens))
    n = max(len(h) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def size_class(n_words: int) -> int:
    """Class of a text by size: texts of one class differ by less than a factor of two."""
    return max(n_words, 1).bit_length() - 1


def stretches(n_words: int) -> list[tuple[int, int]]:
    """Ranges of shingles of an item; every passage covers at least one of them.
    None for items without a passage."""
    n = n_words - SHINGLE + 1
    if n_words < PASSAGE:
        return []
    if size_class(n_words) <= SHORT:
        return [(n - SPAN, SPAN)]
    return [(k, k + STRETCH) for k in range(0, n - STRETCH + 1, STRETCH)]


def threshold(of_class: int) -> float:
    """The least containment of a signature that a passage of an item of this class gives."""
    return 1 / len(stretches((2 << of_class) - 1))


class Index:
    """Signatures of a block of items by size class, and the items' words."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.size = [0] * len(items)
        self.places: dict[int, dict[int, list[tuple[int, list[int]]]]] = defaultdict(dict)
        for k, w in enumerate(self.words):
            ranges = stretches(len(w))
            if not ranges:
                continue
            h = shingle_hashes(w)
            signature = {int(h[a:b].min()) for a, b in ranges}
            self.size[k] = len(signature)
            at: dict[int, list[int]] = defaultdict(list)
            for p, x in enumerate(h.tolist()):
                if x in signature:
                    at[x].append(p)
            of_class = self.places[size_class(len(w))]
            for x, p in at.items():
                of_class.setdefault(x, []).append((k, p))
        self.sorted = {c: np.array(sorted(d), np.uint64) for c, d in self.places.items()}
        # a coarse table of the hashes' first bits spares most shingles the search
        self.bits = {c: min(24, max(12, 5 + len(x).bit_length())) for c, x in self.sorted.items()}
        self.coarse = {}
        for c, x in self.sorted.items():
            t = np.zeros(1 << self.bits[c], bool)
            t[x >> np.uint64(64 - self.bits[c])] = True
            self.coarse[c] = t

    def hits(self, h: np.ndarray, of_class: int) -> np.ndarray:
        """Places in ``h`` whose hash is in a signature of the class."""
        near = np.nonzero(self.coarse[of_class][h >> np.uint64(64 - self.bits[of_class])])[0]
        known = self.sorted[of_class]
        at = np.searchsorted(known, h[near])
        at[at == len(known)] = 0
        return near[known[at] == h[near]]


def _has_passage(doc: list[str], at: int, item: list[str], places: list[int], low: int, high: int) -> bool:
    """Whether words ``low`` to ``high`` of ``doc`` hold PASSAGE words of ``item`` around
    the shingle that stands at ``at`` and, in the item, at ``places``."""
    for q in places:
        a, b = 0, SHINGLE
        if any(doc[at + k].lower() != item[q + k] for k in range(SHINGLE)):
            continue
        while b - a < PASSAGE and at + b < high and q + b < len(item) and doc[at + b].lower() == item[q + b]:
            b += 1
        while b - a < PASSAGE and at + a > low and q + a > 0 and doc[at + a - 1].lower() == item[q + a - 1]:
            a -= 1
        if b - a >= PASSAGE:
            return True
    return False


def _search(index: Index, ids: list, lengths: list[int], tokens: list[str]) -> Iterator[tuple]:
    """(doc, item, doc_class, item_class, shared, est_containment, leaked) of documents
    whose words stand in ``tokens`` one after the other."""
    ends = np.cumsum(lengths)
    h = shingle_hashes(tokens)
    for c in index.places:
        shared: dict[tuple[int, int], set[int]] = defaultdict(set)
        leaked: set[tuple[int, int]] = set()
        hits = index.hits(h, c)
        docs = np.searchsorted(ends, hits, "right")
        inside = hits + SHINGLE <= ends[docs] if len(hits) else np.zeros(0, bool)
        for p, d in zip(hits[inside].tolist(), docs[inside].tolist()):
            x = int(h[p])
            high = int(ends[d])
            for k, places in index.places[c][x]:
                shared[d, k].add(x)
                if (d, k) not in leaked and _has_passage(tokens, p, index.words[k], places, high - lengths[d], high):
                    leaked.add((d, k))
        least = threshold(c)
        for (d, k), both in shared.items():
            part = len(both) / index.size[k]
            if part >= least:
                yield ids[d], index.ids[k], size_class(lengths[d]), c, len(both), part, (d, k) in leaked


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, doc_class, item_class, shared, est_containment, leaked): documents
    that hold enough of an item's signature for its size class, and whether they
    hold PASSAGE consecutive words of it.

    Documents are tokenised whole, in one pass for each BLOCK_BYTES of items; a
    document in several rows is found in each of them.  Null, blank and short
    texts have no passages.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = source.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kinds = (dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id])
    of_item = to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_class int, item_class int, shared int, est_containment double, leaked boolean"
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter("text is not null")
    out = None
    for block in range(n_blocks):
        part = source if n_blocks == 1 else source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        index = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in part.collect()]))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for b in batches:
                rows: list[tuple] = []
                ids, lengths, tokens = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = _WORD.findall(t)
                    if len(w) < PASSAGE:
                        continue
                    ids.append(i)
                    lengths.append(len(w))
                    tokens += w
                    if len(tokens) >= BLOCK_WORDS:
                        rows += _search(known, ids, lengths, tokens)
                        ids, lengths, tokens = [], [], []
                if tokens:
                    rows += _search(known, ids, lengths, tokens)
                columns = list(zip(*rows)) if rows else [[]] * 7
                types = (b.schema.field(0).type, of_item, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "doc_class", "item_class", "shared", "est_containment", "leaked"])

        got = body.mapInArrow(scan, schema)
        out = got if out is None else out.unionByName(got)
    return out


def candidates(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id, doc_class, item_class, shared, est_containment): what the
    search by signature finds, before verification."""
    return search(docs, items, **columns).drop("leaked")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item, whole or in part."""
    return search(docs, items).filter("leaked").select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_docs): how many documents each item leaked into, 0 included."""
    n = found(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))
