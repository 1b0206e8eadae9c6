"""Findings (notables) and their store."""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailrace.detect.rules import Rule
from tailrace.io import hadoop

STATUSES = ("new", "in_progress", "resolved", "closed")
OPEN = ("new", "in_progress")
CAP = 10_000
# Fixed value: severities from least to most.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def notable(rule: Rule, hosts: str, rows: list[dict]) -> dict:
    now = datetime.now(timezone.utc)
    return {
        "id": uuid.uuid4().hex, "rule_id": rule.id, "rule_name": rule.name, "severity": rule.severity, "title": f"{rule.name}: {hosts}" if hosts else rule.name, "description": rule.description,
        "mitre": list(rule.techniques), "risk_score": rule.risk_score, "status": "new", "source": "detection", "host": hosts,
        "contributing_events": [{k: str(v) for k, v in r.items() if v is not None} for r in rows], "created_at": now, "updated_at": now,
    }


class NotableStore:
    """Findings of a running engine, the latest CAP of them, in memory of the driver."""

    def __init__(self, cap: int = CAP):
        self.cap = cap
        self._rows: dict[str, dict] = {}
        self._lock = threading.Lock()

    def add(self, n: dict) -> None:
        with self._lock:
            self._rows[n["id"]] = n
            while len(self._rows) > self.cap:
                self._rows.pop(next(iter(self._rows)))

    def get(self, id: str) -> dict | None:
        return self._rows.get(id)

    def update_status(self, id: str, status: str) -> dict | None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        with self._lock:
            n = self._rows.get(id)
            if n is not None:
                n |= {"status": status, "updated_at": datetime.now(timezone.utc)}
            return n

    def list(self, severity: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        """Newest first."""
        with self._lock:
            rows = [n for n in self._rows.values() if severity in (None, n["severity"]) and status in (None, n["status"])]
        return sorted(reversed(rows), key=lambda n: n["created_at"], reverse=True)[offset : offset + limit]

    def count_by_severity(self) -> dict[str, int]:
        return dict(Counter(n["severity"] for n in self._rows.values()))

    def count_open(self) -> int:
        return sum(n["status"] in OPEN for n in self._rows.values())


# --- the same over a stored table of notables -----------------------------------


def severity_key(c):
    """A severity as it is compared: lower case, without outer blanks."""
    return F.lower(F.trim(c))


def latest_states(rows: DataFrame) -> DataFrame:
    """The last stored row of each id; rows without id are left out."""
    last = rows.filter("id is not null").groupBy("id").agg(F.max("row_id").alias("row_id"))
    return rows.join(last.select("row_id"), "row_id", "left_semi")


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.groupBy(severity_key(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, severity: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, rows of the same time by falling row_id."""
    if severity is not None:
        rows = rows.filter(severity_key(F.col("severity")) == severity.lower())
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("row_id")).offset(offset).limit(limit)


def capped(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest ``cap`` rows by row_id."""
    return rows.orderBy(F.desc("row_id")).limit(cap)


def throttled(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """The first finding of each rule and host within each window of time."""
    w = Window.partitionBy("rule_id", "host", F.window(F.col("created_at").cast("timestamp"), window)).orderBy("created_at", "row_id")
    return rows.filter("created_at is not null").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def contributing(rows: DataFrame) -> DataFrame:
    """(row_id, event_no, key, value): the events that findings rest on, field by field."""
    events = rows.select("row_id", F.posexplode("contributing_events").alias("event_no", "event"))
    return events.select("row_id", "event_no", F.explode("event").alias("key", "value"))


class NotableTable:
    """Findings as a table below ``path``: each stored state is a row, the newest of an
    id counts.  States are only added, so nothing is lost by a restart."""

    SCHEMA = (
        "row_id bigint, id string, rule_id string, rule_name string, severity string, title string, description string, mitre array<string>, risk_score int, status string, "
        "source string, host string, contributing_events array<map<string,string>>, created_at timestamp, updated_at timestamp"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def states(self) -> DataFrame:
        at, fs = hadoop(self.spark, self.path)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if fs.exists(at) else self.spark.createDataFrame([], self.SCHEMA)

    def current(self) -> DataFrame:
        return latest_states(self.states())

    def _store(self, rows: DataFrame) -> None:
        # rows of later calls have greater ids
        now = time.time_ns() // 1000
        rows.withColumn("row_id", F.lit(now) * 1000 + F.monotonically_increasing_id() % 1000).select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)

    def add(self, findings: list[dict]) -> None:
        """Stores findings as :func:`notable` makes them, up to 1000 in a call."""
        if not 0 < len(findings) <= 1000:
            raise ValueError("from 1 to 1000 findings in a call")
        schema = self.SCHEMA.split(", ", 1)[1]
        self._store(self.spark.createDataFrame([tuple(n[c.split()[0]] for c in schema.split(", ")) for n in findings], schema))

    def update_status(self, id: str, status: str) -> bool:
        """Stores the finding anew with another status; False if there is none of that id."""
        if status not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        found = self.current().filter(F.col("id") == id)
        rows = found.limit(1).collect()
        if not rows:
            return False
        row = rows[0].asDict() | {"status": status, "updated_at": datetime.now(timezone.utc)}
        self.add([row])
        return True
