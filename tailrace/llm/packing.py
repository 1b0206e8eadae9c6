"""Filling fixed-capacity containers with texts (problem 8): variable-capacity best fit.

Sizes are tokens of a public tokenizer.  Texts longer than the largest
permitted length are cut into full pieces and a rest; everything else stays
whole.  Items are spread over packing groups by a hash of their id, so that
every group has the same mix of sizes and a bounded number of items; a group is
packed by one task: items by falling size, each into the open bin it fills
best, a new bin in the length that costs least, and at the end every bin is
downsized to the least permitted length that holds its contents.
"""

from __future__ import annotations

import base64
import math
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.io import saved

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
CAPACITY = 2048
LENGTHS = (256, 512, 1024, 2048)
#: Items of one packing group.
GROUP_ITEMS = 50_000
#: Tokens that every opened bin costs besides its length.
BIN_COST = 16
#: Characters of a text that are encoded at once, or up to the next place where a token must end.
PIECE_CHARS = 200_000
_MUST_END = re.compile(r"\S[ \n]")

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # Fixed value: the pattern of the public byte-level vocabulary.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _n_tokens(encoding, text: str) -> int:
    """Tokens of a text.  A long one is encoded piece by piece, cut where a token must
    end whatever surrounds it: no token goes on from a character to a blank after
    it.  A run without such a place is encoded as a whole, so the count doesn't
    depend on PIECE_CHARS."""
    total, at = 0, 0
    while len(text) - at > PIECE_CHARS:
        m = _MUST_END.search(text, at + PIECE_CHARS - 1)
        if m is None:
            break
        total += len(encoding.encode_ordinary(text[at : m.end() - 1]))
        at = m.end() - 1
    return total + len(encoding.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, n_tokens) of every document; 0 for null and empty texts."""
    path = os.path.join(tokenizer_dir, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for b in batches:
            sizes = [0 if not t else _n_tokens(encoding, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {dict(docs.dtypes)[id_col]}, n_tokens bigint")


def cut(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, size): items as they are, longer ones in full pieces and a rest.
    Items of size 0 need no room and are left out."""
    pieces = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    return (
        sizes.filter("n_tokens > 0")
        .select("id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        .select("id", "piece", F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    )


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[int], list[int]]:
    """(bin of each item, length of each bin).

    Items in the order of falling size; each goes into the open bin that it
    leaves the least room in.  If none has room, a bin is opened in the length
    with the least cost for a token of contents, where the room left after the
    item can be filled with at most what smaller items remain.
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    # below[v]: total size of the items not placed yet of size at most v
    top = lengths[-1]
    volume = [0] * (top + 2)

    def add(v: int, by: int) -> None:
        while v <= top:
            volume[v] += by
            v += v & -v

    def below(v: int) -> int:
        total = 0
        while v > 0:
            total += volume[v]
            v -= v & -v
        return total

    for s in sizes:
        add(s, s)
    where, used, opened = [0] * len(sizes), [], []
    rooms: list[int] = []  # distinct free rooms, ascending
    stacks: dict[int, list[int]] = {}
    for i in order:
        s = sizes[i]
        add(s, -s)
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = stacks[room].pop()
            if not stacks[room]:
                del stacks[room]
                rooms.pop(at)
        else:
            def price(length: int) -> float:
                return (length + bin_cost) / (s + min(length - s, below(length - s)))

            length = min((x for x in lengths if x >= s), key=lambda x: (price(x), -x))
            b, room = len(used), length
            used.append(0)
            opened.append(length)
        where[i] = b
        used[b] += s
        left = room - s
        if left > 0:
            if left not in stacks:
                stacks[left] = []
                insort(rooms, left)
            stacks[left].append(b)
    return where, [lengths[bisect_left(lengths, u)] for u in used]


def pack(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(id, piece, size, group_no, bin_no, bin_length, bin_offset) for items (id, piece, size).

    The number of groups follows the number of items, so a group's size, and
    with it a task's memory, stays the same at any scale.  Bins of different
    groups are never joined: at most the last bins of a group are not full.
    """
    n_groups = max(1, math.ceil(items.count() / group_items))
    kind = dict(items.dtypes)["id"]
    schema = f"id {kind}, piece int, size int, group_no int, bin_no int, bin_length int, bin_offset int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where, length = best_fit(pdf["size"].tolist(), lengths)
        pdf["bin_no"] = where
        pdf["bin_length"] = [length[b] for b in where]
        pdf["bin_offset"] = pdf.groupby("bin_no")["size"].cumsum() - pdf["size"]
        return pdf[["id", "piece", "size", "group_no", "bin_no", "bin_length", "bin_offset"]]

    grouped = items.withColumn("group_no", F.pmod(F.xxhash64("id", "piece"), F.lit(n_groups)).cast("int"))
    return grouped.groupBy("group_no").applyInPandas(one, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS, tokenizer_dir: str = TOKENIZERS) -> DataFrame:
    """(doc_id, piece, n_tokens, container, container_tokens, start): where every piece
    of every non-empty text goes.  Containers hold at most ``capacity`` tokens."""
    items = saved(cut(token_counts(docs, tokenizer_dir=tokenizer_dir), capacity), "sizes")
    placed = pack(items, tuple(x for x in lengths if x < capacity) + (capacity,))
    return placed.select(
        F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.concat_ws("-", "group_no", "bin_no").alias("container"), F.col("bin_length").alias("container_tokens"), F.col("bin_offset").alias("start")
    )


def faults(placed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (n_items, n_lost, n_over, n_misplaced, well_filled): items with tokens; those
    whose pieces don't add up to their size; containers that hold more than their
    length or are longer than ``capacity``; pieces that don't begin where the one
    before ends; and whether less than 1 % of the containers' tokens is unused."""
    whole = sizes.filter("n_tokens > 0").groupBy("id").agg(F.sum("n_tokens").alias("size"))
    got = placed.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_tokens").alias("t"))
    lost = whole.join(got, "id", "full").agg(F.count("size").alias("n_items"), F.count_if(~F.col("size").eqNullSafe(F.col("t"))).alias("n_lost"))
    # a container holds at most ``capacity`` pieces
    in_bin = Window.partitionBy("container").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("off", F.col("start") != F.coalesce(F.sum("n_tokens").over(in_bin), F.lit(0)))
    bins = begun.groupBy("container").agg(F.max("container_tokens").alias("room"), F.sum("n_tokens").alias("t"), F.count_if("off").alias("off"))
    over = F.count_if((F.col("t") > F.col("room")) | (F.col("room") > capacity)).alias("n_over")
    checked = bins.agg(over, F.coalesce(F.sum("off"), F.lit(0)).cast("bigint").alias("n_misplaced"), F.coalesce(F.sum("room") - F.sum("t") < 0.01 * F.sum("room"), F.lit(True)).alias("well_filled"))
    return lost.join(F.broadcast(checked))


def fill(placed: DataFrame) -> DataFrame:
    """(container_tokens, n_containers, n_pieces, tokens, unused_share) of a packing."""
    bins = placed.groupBy("container", "container_tokens").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return bins.groupBy("container_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("tokens"), (1 - F.sum("t") / F.sum("container_tokens")).alias("unused_share"))
