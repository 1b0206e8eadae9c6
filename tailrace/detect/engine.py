"""Runs rules: each by itself, or many in one scan."""

from __future__ import annotations

import logging
import threading
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.detect.conditions import met
from tailrace.detect.notables import NotableStore, notable
from tailrace.detect.rules import BUILTIN, Rule
from tailrace.lang import ast
from tailrace.lang.parser import parse
from tailrace.plans.catalog import Catalog
from tailrace.plans.compile import Compiler, time_bound
from tailrace.plans.expr import Scope, condition_of

log = logging.getLogger(__name__)


@dataclass
class Detector:
    catalog: Catalog
    store: NotableStore
    rules: tuple[Rule, ...] = BUILTIN
    threads: int = 4

    def add_rule(self, rule: Rule) -> None:
        self.rules = (*self.rules, rule)

    def evaluate(self, rule: Rule) -> dict | None:
        """The finding of one rule, or None: hosts are those of the first ten rows (three
        named at most), the first five rows are kept with it."""
        result = Compiler(self.catalog).compile(rule.query, earliest=rule.earliest)
        if not met(result, rule.condition):
            return None
        order = [c for c in ("count", "host") if c in result.columns]
        rows = [r.asDict() for r in result.orderBy(*[F.col(c).desc() if c == "count" else F.col(c) for c in order]).limit(10).collect()]
        hosts = list(dict.fromkeys(str(r["host"]) for r in rows if r.get("host") is not None))[:3]
        return notable(rule, ", ".join(hosts), rows[:5])

    def run_all(self) -> list[dict]:
        """Evaluates every rule; one that fails is logged and doesn't stop the others."""

        def one(rule: Rule) -> dict | None:
            try:
                return self.evaluate(rule)
            except Exception:
                log.exception("rule %s failed", rule.id)
                return None

        with ThreadPoolExecutor(self.threads) as pool:
            found = [n for n in pool.map(one, self.rules) if n is not None]
        for n in found:
            self.store.add(n)
        return found

    def loop(self, stop: threading.Event, period: float = 60.0, delay: float = 5.0) -> None:
        """Runs all rules every ``period`` seconds until ``stop`` is set."""
        if stop.wait(delay):
            return
        while not stop.is_set():
            self.run_all()
            stop.wait(period)


def matches(catalog: Catalog, rules: Iterable[Rule], indexes: tuple[str, ...] = ("main",)) -> DataFrame:
    """(rule_id, host, n): what all rules' searches find by host, from one scan, before
    the commands after the count.

    Each rule is one counted condition of a single aggregation, within the
    indexes and times its search names and its ``earliest``.  Refused are rules
    whose query isn't a search followed by a count by host and then ``where``
    only, and rules over indexes that aren't scanned.
    """
    # the texts are lowered once for all conditions
    events = catalog.load(indexes).withColumn("__lowered", F.lower("_raw"))
    scope = Scope(events)
    scanned = set(catalog.select(indexes))
    counts, ids = [], []
    for rule in rules:
        search = _split(rule)[0]
        names = catalog.select(search.indexes)
        if not names or not set(names) <= scanned:
            raise ValueError(f"rule {rule.id} searches indexes that are not scanned")
        hit = F.lit(True) if search.condition is None else condition_of(search.condition, scope)
        if set(names) != scanned:
            hit = F.col("index").isin(names) & hit
        for bound in (rule.earliest, search.earliest):
            hit = (F.col("_time") >= time_bound(bound)) & hit if bound else hit
        if search.latest:
            hit = (F.col("_time") <= time_bound(search.latest)) & hit
        counts.append(F.count(F.when(hit, 1)).alias(rule.id))
        ids.append(rule.id)
    wide = events.groupBy("host").agg(*counts)
    return wide.unpivot("host", ids, "rule_id", "n").filter("n > 0").select("rule_id", "host", "n")


def _split(rule: Rule) -> tuple[ast.Search, str, list[ast.Where]]:
    """The search, the name of the count and the filters after it."""
    first, *rest = parse(rule.query).commands
    stats = rest[0] if rest else None
    counted = isinstance(first, ast.Search) and isinstance(stats, ast.Stats) and stats.by == ("host",)
    if not (counted and [(a.func, a.arg) for a in stats.aggregates] == [("count", None)] and all(isinstance(c, ast.Where) for c in rest[1:])):
        raise ValueError(f"rule {rule.id} is no search with a count by host, filtered by where")
    return first, stats.aggregates[0].name, rest[1:]


def over_threshold(counts: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rows of ``counts`` (as of :func:`matches`) that pass the ``where`` commands
    after the count of their rule."""
    for rule in rules:
        _, name, filters = _split(rule)
        if filters:
            scope = Scope(counts.select("host", F.col("n").alias(name)), extract=False)
            passed = reduce(lambda a, b: a & b, [condition_of(c.condition, scope) for c in filters])
            counts = counts.withColumn(name, F.col("n")).withColumn("__kept", (F.col("rule_id") != rule.id) | passed).filter("__kept").select("rule_id", "host", "n")
    return counts


def single_scan(catalog: Catalog, rules: Iterable[Rule], indexes: tuple[str, ...] = ("main",)) -> DataFrame:
    """(rule_id, host, n): the counts of :func:`matches` that pass the rest of their rule."""
    rules = tuple(rules)
    return over_threshold(matches(catalog, rules, indexes), rules)
