"""Written times, log headers and syslog envelopes in SQL, to hold results against.

These are definitions of their own: patterns without look-around over the whole
text, no grammar and no dictionary.
"""

from __future__ import annotations

from tailrace.functions.instants import MONTHS, ZONE_HOURS

_MON = "|".join(MONTHS)
_CLOCK = r"(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d{1,12}))?"
_ZONE = r"( ?(?:Z|[+-]\d\d:?\d\d)\b| (?:" + "|".join(ZONE_HOURS) + r")\b)?"

# kind -> (pattern, names of its groups)
_KINDS = {
    "iso": (r"(\d{4})-(\d\d)-(\d\d)[T ]" + _CLOCK + _ZONE, "y m d h mi s f zone"),
    "log": (rf"(\d\d)/({_MON})/(\d{{4}}):" + _CLOCK + _ZONE, "d mon y h mi s f zone"),
    "us": (r"(\d{1,2})/(\d{1,2})/(\d{4}) " + _CLOCK + r"(?: ?([AaPp])[Mm])?" + _ZONE, "m d y h mi s f half zone"),
    "dot": (r"(\d{1,2})\.(\d{1,2})\.(\d{4}) " + _CLOCK + _ZONE, "d m y h mi s f zone"),
    "mon": (rf"({_MON}) {{1,2}}(\d{{1,2}}) " + _CLOCK + _ZONE, "mon d h mi s f zone"),
    "short": (r"[DIWEF](\d\d)(\d\d) " + _CLOCK + r"\b", "m d h mi s f"),
}
_NUMBER = r"(1\d{9})(?:\.(\d{1,12})|(\d{3}|\d{6}|\d{9}))?(?:[^\w.]|$)"


def _plain(pattern: str) -> str:
    """``pattern`` without groups that capture."""
    return pattern.replace("(?:", "\0").replace("(", "(?:").replace("\0", "(?:")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: A time begins where no letter or digit stands before it.
_DATED = r"(?:^|[^0-9A-Za-z])(" + "|".join(_plain(p) for p, _ in _KINDS.values()) + ")"
_COUNTED = r"(?:^|[^\w./-])(" + _plain(_NUMBER) + ")"


def _part(name: str) -> str:
    """SQL for one part of a written time in column ``t``, '' if it has none."""
    cases = []
    for kind, (pattern, names) in _KINDS.items():
        names = names.split()
        if name in names:
            cases.append(f"WHEN k = '{kind}' THEN regexp_extract(t, {_q('^' + pattern)}, {names.index(name) + 1})")
    return f"CASE {' '.join(cases)} ELSE '' END"


def instants(source: str) -> str:
    """CTEs that end in ``written`` (all columns of ``source``, written_us), for a
    relation ``source`` with columns raw, host and received_us."""
    host = r"regexp_replace(lower(trim({})), '\.$', '')"
    kind = " ".join(f"WHEN regexp_matches(t, {_q('^' + p)}) THEN '{k}'" for k, (p, _) in _KINDS.items())
    months = " ".join(f"WHEN '{m}' THEN '{k + 1}'" for k, m in enumerate(MONTHS))
    zones = " ".join(f"WHEN '{z}' THEN {int(h * 60)}" for z, h in ZONE_HOURS.items())
    parts = ", ".join(f"{_part(n)} AS {n}_" for n in ("y", "m", "mon", "d", "h", "mi", "s", "f", "half", "zone"))
    local = "TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', {y}, mo, da, ho, TRY_CAST(mi_ AS INTEGER), TRY_CAST(s_ AS INTEGER)) AS TIMESTAMP)"

    def instant(year: str) -> str:
        at = local.format(y=year)
        wall = f"epoch_us(({at}) AT TIME ZONE zone)"
        # a wall clock that shows a time twice means the earlier
        earlier = f"CASE WHEN timezone(zone, make_timestamptz({wall} - 3600000000)) = ({at}) THEN {wall} - 3600000000 ELSE {wall} END"
        return f"(CASE WHEN ahead IS NULL THEN {earlier} ELSE epoch_us({at}) - CAST(ahead AS BIGINT) * 60000000 END + fraction)"

    fraction = "coalesce(TRY_CAST(rpad(substr({f}, 1, 6), 6, '0') AS BIGINT), 0)"
    number = lambda g: f"regexp_extract(c, {_q('^' + _NUMBER)}, {g})"
    return f"""zoned AS (SELECT {host.format('hostname')} AS zh, min(time_zone) AS zone FROM asset WHERE hostname IS NOT NULL AND time_zone IS NOT NULL GROUP BY 1),
found AS (SELECT s.*, coalesce(zone, 'UTC') AS zone, regexp_extract(raw, {_q(_DATED)}, 1) AS t, regexp_extract(raw, {_q(_COUNTED)}, 1) AS c FROM {source} s LEFT JOIN zoned ON zh = {host.format('host')}),
kinds AS (SELECT *, CASE {kind} END AS k FROM found),
parts AS (SELECT *, {parts} FROM kinds),
numbers AS (SELECT *, TRY_CAST(y_ AS INTEGER) AS yr, coalesce(TRY_CAST(m_ AS INTEGER), TRY_CAST(CASE mon_ {months} END AS INTEGER)) AS mo, TRY_CAST(d_ AS INTEGER) AS da,
CASE WHEN upper(half_) = 'P' THEN TRY_CAST(h_ AS INTEGER) % 12 + 12 WHEN upper(half_) = 'A' THEN TRY_CAST(h_ AS INTEGER) % 12 ELSE TRY_CAST(h_ AS INTEGER) END AS ho, {fraction.format(f='f_')} AS fraction,
CASE WHEN trim(zone_) = 'Z' THEN 0 WHEN regexp_matches(zone_, '^ ?[+-]') THEN (CASE WHEN contains(zone_, '-') THEN -1 ELSE 1 END) * (CAST(substr(trim(zone_), 2, 2) AS INTEGER) * 60 + CAST(right(zone_, 2) AS INTEGER)) ELSE CASE trim(zone_) {zones} END END AS ahead,
year(make_timestamp(coalesce(received_us, 0))) AS ry FROM parts),
three AS (SELECT *, CASE WHEN k IS NULL THEN [] WHEN yr IS NOT NULL THEN [{instant('yr')}] ELSE [{instant('ry - 1')}, {instant('ry')}, {instant('ry + 1')}] END AS candidates FROM numbers),
written AS (SELECT * EXCLUDE (zone, t, c, k, y_, m_, mon_, d_, h_, mi_, s_, f_, half_, zone_, yr, mo, da, ho, fraction, ahead, ry, candidates), CASE WHEN k IS NULL THEN CASE WHEN c <> '' THEN
CAST({number(1)} AS BIGINT) * 1000000 + CASE WHEN {number(3)} <> '' THEN {fraction.format(f=number(3))} ELSE {fraction.format(f=number(2))} END END
WHEN len(list_filter(candidates, lambda x: x IS NOT NULL)) <= 1 THEN list_filter(candidates, lambda x: x IS NOT NULL)[1]
ELSE list_sort(list_transform(list_filter(candidates, lambda x: x IS NOT NULL), lambda x: {{'far': abs(x - received_us), 'at': x}}))[1].at END AS written_us FROM three)"""


_UNIT = "CASE WHEN {n} < 100000000000 THEN {n} * 1000000 WHEN {n} < 100000000000000 THEN {n} * 1000 WHEN {n} < 100000000000000000 THEN {n} ELSE {n} // 1000 END"

REPAIRED = f"""WITH missing AS (SELECT 'wire_event' AS table_name, delivery_id AS rec_id, raw, host, epoch_us(received_at) AS received_us FROM wire_event WHERE coalesce(event_time.seconds, 0) = 0
UNION ALL SELECT 'ingest_event', ingest_id, raw, host, received_us FROM ingest_event WHERE coalesce(timestamp_us, 0) = 0), {instants('missing')}
SELECT table_name, rec_id, CAST(written_us AS BIGINT) AS event_us FROM written WHERE written_us IS NOT NULL
UNION ALL SELECT 'wire_event', delivery_id, CAST({_UNIT.format(n='event_time.seconds')} + CASE WHEN event_time.microseconds > 999999 THEN event_time.microseconds // 1000 ELSE coalesce(event_time.microseconds, 0) END AS BIGINT)
FROM wire_event WHERE event_time.seconds <> 0 AND (event_time.seconds >= 100000000000 OR event_time.microseconds > 999999)
UNION ALL SELECT 'ingest_event', ingest_id, CAST({_UNIT.format(n='timestamp_us')} AS BIGINT) FROM ingest_event WHERE timestamp_us <> 0 AND (timestamp_us < 100000000000000 OR timestamp_us >= 100000000000000000)"""

INGEST_WRITTEN = f"WITH {instants('ingest_event')} SELECT ingest_id, CAST(written_us AS BIGINT) AS written_us FROM written"

_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,12})?(?:Z|[+-]\d\d:?\d\d)?"
_EPOCH = r"1\d{9}(?:\.\d{1,12}|\d{3}|\d{6}|\d{9})?"
_LEVELS = "(?i:debug|trace|dbg|info|notice|warn|warning|error|err|fatal|critical|crit|emerg|panic|[diwef])"
_DAY = rf"(?:{_MON}) {{1,2}}\d{{1,2}} \d\d:\d\d:\d\d"
_DOTTED = r"\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d\d:\d\d(?:[.,]\d{1,12})?"

# layout -> (pattern, groups of priority, level, writer and text; 0: none)
_HEADERS = {
    "numbered": (rf"^<(\d{{1,3}})>\d+ {_ISO} \S+ (\S+) \S+ \S+ \S+ (?s:(.*))$", (1, 0, 2, 3)),
    "dated": (rf"^(?:<(\d{{1,3}})>)?{_DAY} \S+ ([^\s:\[]+)(?:\[\d+\])?: (?s:(.*))$", (1, 0, 2, 3)),
    "short": (r"^([DIWEF])\d{4} \d\d:\d\d:\d\d(?:\.\d+)? +\d+ ([^\s:\]]+)(?::\d+)?\] (?s:(.*))$", (0, 1, 2, 3)),
    "threaded": (rf"^{_ISO} \[[^\]]*\] ({_LEVELS}) +(\S+) - (?s:(.*))$", (0, 1, 2, 3)),
    "boxed": (rf"^\[{_ISO}\] \[([^\]]+)\] \[([^\]]+)\] (?s:(.*))$", (0, 1, 2, 3)),
    "barred": (rf"^{_EPOCH}\|([^|]+)\|([^|]+)\|(?s:(.*))$", (0, 1, 2, 3)),
    "led": (rf"^({_LEVELS}) +{_ISO}(?: (?:[+-]\d{{4}}|[A-Z]{{2,4}}))? (\S+): (?s:(.*))$", (0, 1, 2, 3)),
    "semicolons": (rf"^{_DOTTED};([^;]+);({_LEVELS});(?s:(.*))$", (0, 2, 1, 3)),
    "angled": (rf"^{_DOTTED} <({_LEVELS})> (\S+): (?s:(.*))$", (0, 1, 2, 3)),
    "named": (r"(?s)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d(?: ?[AP]M)?.*\bLevel=(\w+)\s+Source=(\S+)\s+Message=(.*)$", (0, 1, 2, 3)),
    "web": (rf"^\S+ \S+ \S+ \[\d\d/(?:{_MON})/\d{{4}}:\d\d:\d\d:\d\d [+-]\d{{4}}\] (?s:(.*))$", (0, 0, 0, 1)),
}
_KEY_TIME = "(?:ts|time|when|@timestamp|timestamp|datetime|date)"
_KEY_LEVEL = "(?:level|lvl|severity|sev|loglevel)"
_KEY_WRITER = "(?:component|svc|service|logger|app|source|program|module)"
_KEY_TEXT = "(?:msg|message|text)"
_MEMBERS = rf'"{_KEY_TIME}"\s*:\s*"?(?:{_ISO}|{_EPOCH})"?\s*[,}}]'
_PAIRS = rf'(?i)(?:^|\s){_KEY_TIME}="?(?:{_ISO}|{_EPOCH})"?(?:\s|$)'


def _headers(group: int) -> str:
    """SQL for one field (0 priority, 1 level, 2 writer, 3 text) of the layout ``k``."""
    cases = " ".join(f"WHEN '{k}' THEN regexp_extract(raw, {_q(p)}, {g[group]})" for k, (p, g) in _HEADERS.items() if g[group])
    json_key, pair_key = {1: (_KEY_LEVEL, _KEY_LEVEL), 2: (_KEY_WRITER, _KEY_WRITER), 3: (_KEY_TEXT, _KEY_TEXT)}.get(group, (None, None))
    if json_key:
        member = '"' + json_key + r'"\s*:\s*"((?:[^"\\]|\\.)*)"'
        pair = r"(?i)(?:^|\s)" + pair_key + r'=(?:"((?:[^"\\]|\\.)*)"|(\S+))'
        cases += f" WHEN 'json' THEN regexp_extract(raw, {_q(member)}, 1) WHEN 'pairs' THEN regexp_extract(raw, {_q(pair)}, 1) || regexp_extract(raw, {_q(pair)}, 2)"
    return f"CASE k {cases} ELSE '' END"


_LEVEL_OF = {"DEBUG": "debug trace dbg d", "INFO": "info notice i", "WARN": "warn warning w", "ERROR": "error err e", "FATAL": "fatal critical crit emerg panic f"}


def entries(host: str = r"coalesce('=' || regexp_replace(lower(trim(host)), '\.$', ''), '')") -> str:
    """CTEs that end in ``joined``: rows of wire_event with text, what their header says
    (begins, lvl, component, message) and ``entry``, the delivery that begins their entry."""
    kind = " ".join(f"WHEN regexp_matches(raw, {_q(p)}) THEN '{k}'" for k, (p, _) in _HEADERS.items())
    kind += rf" WHEN regexp_matches(raw, '^\s*\{{') THEN CASE WHEN regexp_matches(raw, {_q(_MEMBERS)}) THEN 'json' END WHEN regexp_matches(raw, {_q(_PAIRS)}) THEN 'pairs'"
    # of 'boxed' and 'barred' the level may come second
    levels = " ".join(f"WHEN lower({{0}}) IN ({', '.join(repr(w) for w in words.split())}) THEN '{k}'" for k, words in _LEVEL_OF.items())
    level = lambda c: f"CASE {levels.format(c)} ELSE '' END"
    return f"""lines AS (SELECT *, CASE {kind} END AS k FROM wire_event WHERE regexp_matches(raw, '\\S')),
fields_of AS (SELECT *, {_headers(0)} AS pri, {_headers(1)} AS l1, {_headers(2)} AS w1, {_headers(3)} AS text FROM lines),
headed AS (SELECT *, k IS NOT NULL AS begins, CASE WHEN pri <> '' THEN ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][TRY_CAST(pri AS INTEGER) % 8 + 1] WHEN k IN ('boxed', 'barred') AND {level('l1')} = '' THEN {level('w1')} ELSE {level('l1')} END AS lvl,
CASE WHEN k IN ('boxed', 'barred') AND {level('l1')} = '' THEN l1 WHEN w1 = '-' THEN '' ELSE w1 END AS component FROM fields_of),
joined AS (SELECT *, last_value(CASE WHEN begins THEN delivery_id END IGNORE NULLS) OVER (PARTITION BY batch_id, {host}, coalesce('=' || source, '') ORDER BY batch_pos, delivery_id ROWS UNBOUNDED PRECEDING) AS entry FROM headed)"""


ENTRIES_FOUND = f"""WITH {entries()} SELECT entry AS first_delivery_id, arg_max(delivery_id, (batch_pos, delivery_id)) AS last_delivery_id,
max(lvl) FILTER (begins) AS lvl, max(component) FILTER (begins) AS component FROM joined WHERE entry IS NOT NULL GROUP BY entry HAVING bool_or(begins AND fields IS NULL)"""

ENTRIES = f"""WITH {entries()}, whole AS (SELECT entry, arg_min(raw, (batch_pos, delivery_id)) FILTER (begins) AS raw, max(host) FILTER (begins) AS host, max(epoch_us(received_at)) FILTER (begins) AS received_us,
max(lvl) FILTER (begins) AS lvl, max(component) FILTER (begins) AS component,
string_agg(CASE WHEN begins THEN text ELSE raw END, chr(10) ORDER BY batch_pos, delivery_id) AS message FROM joined WHERE entry IS NOT NULL GROUP BY entry), {instants('whole')}
SELECT entry AS delivery_id, CAST(written_us AS BIGINT) AS event_us, lvl, component, message, CAST(NULL AS VARCHAR) AS unparsed FROM written
UNION ALL SELECT delivery_id, NULL, NULL, NULL, NULL, raw FROM joined WHERE entry IS NULL"""


def syslog(facilities: tuple[str, ...], severities: tuple[str, ...]) -> str:
    """SQL for the envelopes of all lines that have one."""
    v1 = r"^<\d{1,3}>\d{1,2}\s+\S+\s+(\S+)\s+(\S+)\s+\S+\s+\S+\s+"
    bsd = r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+(\S+)\s+([^\s:\[]+)"
    listed = lambda words: "[" + ", ".join(map(repr, words)) + "]"
    known = lambda g: f"nullif(nullif(CASE WHEN regexp_matches(raw, {_q(v1)}) THEN regexp_extract(raw, {_q(v1)}, {g}) ELSE regexp_extract(raw, {_q(bsd)}, {g}) END, ''), '-')"
    return rf"""WITH l AS (SELECT delivery_id, raw, TRY_CAST(nullif(regexp_extract(raw, '^<(\d{{1,3}})>', 1), '') AS INTEGER) AS pri FROM wire_event WHERE regexp_matches(raw, '^<\d{{1,3}}>') OR regexp_matches(raw, {_q(bsd)}))
SELECT delivery_id, coalesce({known(1)}, 'unknown') AS host, coalesce({known(2)}, 'syslog') AS source, coalesce('syslog:' || {listed(facilities)}[pri // 8 + 1], 'syslog') AS sourcetype, {listed(severities)}[pri % 8 + 1] AS severity FROM l"""
