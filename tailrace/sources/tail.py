"""Growing log files as a streaming source (``format("log_tail")``).

The offset of the stream holds how far each file was read.  A micro-batch is
the bytes that were added since, up to the last line end, in pieces of
``pieceBytes`` that executors read side by side; the files must lie where all
of them can read.  A line belongs to the piece it begins in.  A file that has
become shorter was begun anew and is read from its start.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 16 * 1024 * 1024
_BACK = 64 * 1024


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    low: int


def last_line_end(path: str, low: int, size: int) -> int:
    """The end of the last whole line between ``low`` and ``size``; ``low`` if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > low:
            begin = max(low, at - _BACK)
            f.seek(begin)
            k = f.read(at - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.piece = int(options.get("pieceBytes", PIECE))
        self.allow, self.deny = options.get("allow"), options.get("deny")
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        if os.path.isfile(self.root):
            return [self.root]
        found = [os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if not n.startswith(".")]
        return sorted(p for p in found if (not self.allow or re.search(self.allow, p)) and not (self.deny and re.search(self.deny, p)))

    def latestOffset(self) -> dict:
        for p in self._files():
            size = os.path.getsize(p)
            low = self.seen.get(p, 0)
            # shorter than it was: begun anew
            self.seen[p] = last_line_end(p, low if low <= size else 0, size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for p, high in sorted(end.items()):
            low = start.get(p, 0)
            if high < low:
                low = 0
            out += [Piece(p, a, min(a + self.piece, high), low) for a in range(low, high, self.piece)]
        for p, high in end.items():  # after a restart the offsets come from the checkpoint
            self.seen.setdefault(p, high)
        return out

    def read(self, partition: Piece) -> Iterator[tuple[str, str, int]]:
        with open(partition.path, "rb") as f:
            at = partition.start
            if at > partition.low:  # the line that reaches into this piece belongs to the one before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield text, partition.path, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, path string, position bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines added to the files below ``path``, as a stream of (value, path, position)."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).options(**options).load()
