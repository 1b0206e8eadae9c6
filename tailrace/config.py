"""Settings of an engine from a JSON file."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import SparkSession

from tailrace.sources.store import EventStore


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    listen_address: str = "0.0.0.0"
    syslog_udp_port: int = 5514
    syslog_tcp_port: int = 5514
    segment_size_mb: int = 256
    compression: str = "zstd"
    compression_level: int = 3
    shuffle_partitions: int = 200
    detection_period: float = 60.0
    log_file: str = ""
    log_level: str = "info"

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Known settings of the file over the defaults; unknown ones are refused."""
        given = json.loads(Path(path).read_text())
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def apply(self, spark: SparkSession) -> SparkSession:
        """Sets what may be set in a running session; UTC throughout."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.shuffle.partitions", str(self.shuffle_partitions))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.parquet.compression.codec", self.compression)
        return spark

    def store(self, spark: SparkSession) -> EventStore:
        """The event store as configured."""
        return EventStore(spark, self.data_dir, self.compression, level=self.compression_level, target_bytes=self.segment_size_mb * 1024 * 1024)

    def syslog_options(self, protocol: str) -> dict[str, str]:
        """Options of the syslog listener for ``protocol`` udp or tcp."""
        return {"protocol": protocol, "host": self.listen_address, "port": str(self.syslog_udp_port if protocol == "udp" else self.syslog_tcp_port)}

    def start_log(self, most_bytes: int = 10 * 1024 * 1024, kept: int = 5) -> logging.Handler | None:
        """Writes the package's log to ``log_file``, which is begun anew at ``most_bytes``;
        ``kept`` older ones stay.  Nothing without a file."""
        if not self.log_file:
            return None
        handler = RotatingFileHandler(self.log_file, maxBytes=most_bytes, backupCount=kept)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger = logging.getLogger("tailrace")
        logger.setLevel(self.log_level.upper())
        logger.addHandler(handler)
        return handler
