"""Counters, gauges and histograms of an engine, in the Prometheus text form."""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import defaultdict

BUCKETS_MS = (10, 50, 100, 500, 1_000, 5_000, 10_000, 60_000)


class Metrics:
    def __init__(self, prefix: str = "tailrace"):
        self.prefix = prefix
        self._lock = threading.Lock()
        self._counters: dict[str, float] = defaultdict(float)
        self._gauges: dict[str, float] = {}
        self._histograms: dict[str, list] = {}

    def add(self, name: str, n: float = 1) -> None:
        with self._lock:
            self._counters[name] += n

    def set(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    def observe(self, name: str, value: float) -> None:
        with self._lock:
            counts, total = self._histograms.setdefault(name, [[0] * (len(BUCKETS_MS) + 1), 0.0])
            counts[bisect_left(BUCKETS_MS, value)] += 1
            self._histograms[name][1] = total + value

    def text(self) -> str:
        out = []
        with self._lock:
            for kind, values in (("counter", self._counters), ("gauge", self._gauges)):
                for name, v in sorted(values.items()):
                    out += [f"# TYPE {self.prefix}_{name} {kind}", f"{self.prefix}_{name} {v:g}"]
            for name, (counts, total) in sorted(self._histograms.items()):
                out.append(f"# TYPE {self.prefix}_{name} histogram")
                so_far = 0
                for bound, n in zip((*BUCKETS_MS, "+Inf"), counts):
                    so_far += n
                    out.append(f'{self.prefix}_{name}_bucket{{le="{bound}"}} {so_far}')
                out += [f"{self.prefix}_{name}_sum {total:g}", f"{self.prefix}_{name}_count {so_far}"]
        return "\n".join(out) + "\n"
