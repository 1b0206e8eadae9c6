"""The engine: queries, ingest, indexes and health in one object."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tailrace.config import Config
from tailrace.detect.engine import Detector
from tailrace.detect.notables import NotableStore
from tailrace.lang.errors import QueryError
from tailrace.lang.parser import parse
from tailrace.metrics import Metrics
from tailrace.plans.catalog import Catalog
from tailrace.plans.compile import Compiler
from tailrace.plans.semantic import check, referenced_fields, referenced_indexes
from tailrace.sources.normalise import batch, normalise
from tailrace.sources.store import EventStore

MAX_RESULTS = 10_000
MOST_RESULTS = 100_000

#: Queries of the default dashboard.
DASHBOARD = {
    "events over time": "search index=* | timechart count",
    "findings by severity": "search index=notable | stats count by severity",
    "top sources": "search index=* | stats count by source | sort -count | head 10",
}


@dataclass
class SearchResult:
    total_count: int
    columns: list[str]
    events: list[dict]
    execution_time_ms: float

    @property
    def stats(self) -> dict:
        return {"columns": self.columns, "rows": [[e.get(c) for c in self.columns] for e in self.events]}

    def to_json(self) -> str:
        """As a service would answer; times as ISO text."""
        return json.dumps({"total_count": self.total_count, "execution_time_ms": self.execution_time_ms, "columns": self.columns, "events": self.events, "stats": self.stats}, default=str)


class Job:
    """A query that runs in the background: its state, progress and result."""

    def __init__(self, engine: Engine, query: str, options: dict):
        self.id = uuid.uuid4().hex
        self._engine = engine
        self._pool = ThreadPoolExecutor(1)
        self._future = self._pool.submit(self._run, query, options)
        self._pool.shutdown(wait=False)

    def _run(self, query: str, options: dict) -> SearchResult:
        self._engine.spark.sparkContext.setJobGroup(self.id, query, interruptOnCancel=True)
        return self._engine.execute(query, tag=self.id, **options)

    @property
    def status(self) -> str:
        if not self._future.done():
            return "running"
        return "failed" if self._future.exception() else "done"

    def progress(self) -> dict[str, int]:
        """Tasks of the query's stages: how many there are, and how many have ended."""
        tracker = self._engine.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.id)]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        return {"tasks": sum(s.numTasks for s in stages if s), "done": sum(s.numCompletedTasks for s in stages if s)}

    def cancel(self) -> None:
        self._engine.cancel(self.id)

    def result(self, timeout: float | None = None) -> SearchResult:
        return self._future.result(timeout)


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str | None = None, config: Config | None = None):
        """An engine over the store at ``data_dir``, or as ``config`` says."""
        self.spark = config.apply(spark) if config else spark
        self.catalog = Catalog(spark)
        self.store = config.store(spark) if config else EventStore(spark, data_dir) if data_dir else None
        self.period = config.detection_period if config else 60.0
        self.notables = NotableStore()
        self.detector = Detector(self.catalog, self.notables)
        self.metrics = Metrics()
        self._known: set[str] = set()
        self._refresh()

    def _refresh(self) -> None:
        if self.store is not None:
            for name in self.store.indexes():
                if name not in self._known:
                    self.catalog.register(name, lambda n=name: self.store.read(n))
                    self._known.add(name)

    def register(self, name: str, df: DataFrame, **columns) -> None:
        self.catalog.register(name, df, **columns)

    def dataframe(self, query: str, earliest: str | None = None, latest: str | None = None, mode: str = "typed") -> DataFrame:
        self._refresh()
        return Compiler(self.catalog, mode).compile(query, earliest, latest)

    def execute(self, query: str, earliest: str | None = None, latest: str | None = None, max_results: int = MAX_RESULTS, mode: str = "typed", tag: str | None = None) -> SearchResult:
        """Runs a query and brings at most ``max_results`` rows; ``total_count`` is the
        number of rows of the whole result.  Raises QueryError for a bad query.
        A query with a ``tag`` can be stopped by :meth:`cancel` from another thread."""
        if not 0 < max_results <= MOST_RESULTS:
            raise ValueError(f"max_results must be from 1 to {MOST_RESULTS}")
        began = time.perf_counter()
        df = self.dataframe(query, earliest, latest, mode)
        if tag:
            self.spark.addTag(tag)
        try:
            rows = df.limit(max_results + 1).collect()
            total = len(rows) if len(rows) <= max_results else df.count()
        finally:
            if tag:
                self.spark.removeTag(tag)
        events = [r.asDict(recursive=True) for r in rows[:max_results]]
        took = (time.perf_counter() - began) * 1000
        self.metrics.add("queries_total")
        self.metrics.observe("query_ms", took)
        return SearchResult(total, df.columns, events, took)

    def submit(self, query: str, **options) -> Job:
        """Starts a query in the background."""
        return Job(self, query, options)

    def detect(self, stop: threading.Event) -> None:
        """Runs the rules every period until ``stop`` is set."""
        self.detector.loop(stop, self.period)

    def cancel(self, tag: str) -> None:
        """Stops the running queries with this tag."""
        self.spark.interruptTag(tag)

    def parse(self, query: str) -> dict:
        """What a query is made of, or where it is wrong."""
        try:
            tree = parse(query)
            check(tree)
        except QueryError as e:
            return {"valid": False, "errors": [str(e)], "commands": [], "indexes": [], "fields": []}
        return {"valid": True, "errors": [], "commands": [type(c).__name__.lower() for c in tree.commands], "indexes": referenced_indexes(tree), "fields": referenced_fields(tree)}

    def ingest(self, events: Iterable[dict], **defaults: str) -> int:
        """Stores a batch of events; returns how many."""
        if self.store is None:
            raise ValueError("the engine has no data_dir")
        events = list(events)
        self.store.append(normalise(batch(self.spark, events, **defaults)))
        self._refresh()
        self.metrics.add("events_total", len(events))
        return len(events)

    def list_indexes(self) -> list[dict]:
        self._refresh()
        stored = {r.name: r.asDict() for r in self.store.statistics().collect()} if self.store else {}
        return [stored.get(n, {"name": n, "total_events": None, "total_size_bytes": None, "segment_count": None}) for n in self.catalog.names()]

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "indexes": len(self.catalog.names())}

    def dashboard(self) -> dict[str, DataFrame]:
        return {title: self.dataframe(q) for title, q in DASHBOARD.items()}
