"""Syslog envelopes and written times of raw lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailrace.functions.instants import nearest, time_text, written_instants

# Facility names by number.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")

_PRI = r"^<(\d{1,3})>"
_V1 = r"^(?:<\d{1,3}>)\d{1,2}\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
_BSD = r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+(\S+)\s+([^\s:\[]+)(?:\[[^\]]*\])?:?"


def has_envelope(raw: Column) -> Column:
    """Whether a line begins with a priority, or with a date, a host and a program."""
    return raw.rlike(_PRI) | raw.rlike(_BSD)


def _known(c: Column) -> Column:
    return F.when((c != "") & (c != "-"), c)


def syslog_fields(raw: Column, sender: Column | None = None) -> dict[str, Column]:
    """host, source, sourcetype, facility and severity of a syslog line.

    Both envelopes are read; days may be padded with a blank.  A missing host is
    the sender's, else 'unknown'; a missing program 'syslog'.  The sourcetype is
    ``syslog:<facility>``, or ``syslog`` without a priority.
    """
    pri = F.regexp_extract(raw, _PRI, 1).try_cast("int")
    v1 = raw.rlike(_V1)
    facility = F.try_element_at(F.array(*[F.lit(x) for x in FACILITIES]), F.call_function("div", pri, F.lit(8)).cast("int") + 1)
    severity = F.try_element_at(F.array(*[F.lit(x) for x in SEVERITIES]), pri % 8 + 1)
    host = F.when(v1, _known(F.regexp_extract(raw, _V1, 2))).otherwise(_known(F.regexp_extract(raw, _BSD, 1)))
    program = F.when(v1, _known(F.regexp_extract(raw, _V1, 3))).otherwise(_known(F.regexp_extract(raw, _BSD, 2)))
    fallback = F.lit("unknown") if sender is None else F.coalesce(sender, F.lit("unknown"))
    return {
        "host": F.coalesce(host, fallback),
        "source": F.coalesce(program, F.lit("syslog")),
        "sourcetype": F.coalesce(F.concat(F.lit("syslog:"), facility), F.lit("syslog")),
        "facility": facility,
        "severity": severity,
    }


def event_time(raw: Column, reference: Column, zone: str = "UTC") -> Column:
    """The time a raw line states (a timestamp), null if none: ISO, numbers of
    seconds, syslog and web-log dates and others.  Dates without a year get the
    year that brings them next to ``reference``."""
    at = F.unix_micros(reference.cast("timestamp"))
    found = written_instants(F.nullif(time_text(raw), F.lit("")), F.lit(zone), F.year(reference))
    return F.timestamp_micros(nearest(found, at))
