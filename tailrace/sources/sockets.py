"""Syslog over UDP and TCP as a streaming source (``format("syslog_listener")``).

Each micro-batch takes what has arrived on the port; datagrams and lines that
come while no batch is read wait in the socket's buffer; ``maxRows`` bounds what
one batch takes, the rest comes with the next.  Batches are buffered until
committed, so a failed batch is delivered again.  A line without an end is cut
at LINE_LIMIT bytes, as lines of that length.
"""

from __future__ import annotations

import contextlib
import socket
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

DATAGRAM = 64 * 1024
LINE_LIMIT = 1024 * 1024


class SyslogReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.protocol = options.get("protocol", "udp")
        self.most = int(options.get("maxRows", "10000"))
        self.kept: list[tuple[int, list[tuple[str, str]]]] = []
        self.partial: dict[socket.socket, tuple[str, bytes]] = {}
        kind = socket.SOCK_DGRAM if self.protocol == "udp" else socket.SOCK_STREAM
        self.socket = socket.socket(socket.AF_INET, kind)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((options.get("host", "0.0.0.0"), int(options.get("port", "5514"))))
        self.socket.setblocking(False)
        if self.protocol == "tcp":
            self.socket.listen(64)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _udp(self) -> list[tuple[str, str]]:
        out = []
        with contextlib.suppress(BlockingIOError):
            while len(out) < self.most:
                data, (sender, *_) = self.socket.recvfrom(DATAGRAM)
                line = data.decode("utf-8", "replace").rstrip("\r\n")
                if line:
                    out.append((line, sender))
        return out

    def _tcp(self) -> list[tuple[str, str]]:
        with contextlib.suppress(BlockingIOError):
            while True:
                peer, (sender, *_) = self.socket.accept()
                peer.setblocking(False)
                self.partial[peer] = (sender, b"")
        out: list[tuple[str, str]] = []
        for peer, (sender, rest) in list(self.partial.items()):
            closed = False
            try:
                while len(out) < self.most:
                    data = peer.recv(DATAGRAM)
                    if not data:
                        closed = True
                        break
                    *lines, rest = (rest + data).split(b"\n")
                    out += [(x.decode("utf-8", "replace").rstrip("\r"), sender) for x in lines if x.strip()]
                    while len(rest) > LINE_LIMIT:  # no byte of an endless line is lost
                        out.append((rest[:LINE_LIMIT].decode("utf-8", "replace"), sender))
                        rest = rest[LINE_LIMIT:]
            except BlockingIOError:
                pass
            except OSError:
                closed = True
            if closed:
                if rest.strip():
                    out.append((rest.decode("utf-8", "replace"), sender))
                peer.close()
                del self.partial[peer]
            else:
                self.partial[peer] = (sender, rest)
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple[str, str]], dict]:
        rows = self._udp() if self.protocol == "udp" else self._tcp()
        end = {"n": start["n"] + len(rows)}
        if rows:
            self.kept.append((end["n"], rows))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, str]]:
        return iter([r for n, rows in self.kept if start["n"] < n <= end["n"] for r in rows])

    def commit(self, end: dict) -> None:
        self.kept = [(n, rows) for n, rows in self.kept if n > end["n"]]


class SyslogListener(DataSource):
    @classmethod
    def name(cls) -> str:
        return "syslog_listener"

    def schema(self) -> str:
        return "value string, sender string"

    def simpleStreamReader(self, schema) -> SyslogReader:
        return SyslogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyslogListener)
