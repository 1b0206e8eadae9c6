"""Lexer and weighted grammar for log entry headers.

The lexer turns a line into typed tokens (timestamps, levels, keys, quoted
strings, words, marks); :data:`GRAMMAR` says how headers of various programs
are put together from them.  ``parse_line`` returns the fields of the best
parse; whatever the best parse leaves out is reported as unparsed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tailrace.functions.earley import ANY, Rule, WeightedEarley
from tailrace.functions.instants import MONTHS, ZONE_HOURS

# Spellings of levels and names of field keys.
LEVELS = {
    "DEBUG": ("debug", "trace", "dbg", "d"),
    "INFO": ("info", "notice", "i"),
    "WARN": ("warn", "warning", "w"),
    "ERROR": ("error", "err", "e"),
    "FATAL": ("fatal", "critical", "crit", "emerg", "panic", "f"),
}
PRIORITY_LEVELS = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
TIME_KEYS = ("ts", "time", "when", "@timestamp", "timestamp", "datetime", "date")
LEVEL_KEYS = ("level", "lvl", "severity", "sev", "loglevel")
WRITER_KEYS = ("component", "svc", "service", "logger", "app", "source", "program", "module")
TEXT_KEYS = ("msg", "message", "text")

LEVEL_OF = {w: k for k, words in LEVELS.items() for w in words}

_month = "|".join(MONTHS)
_level = "|".join(sorted((w for w in LEVEL_OF if len(w) > 1), key=len, reverse=True))
_iso = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,12})?(?:Z|[+-]\d\d:?\d\d)?"
_epoch = r"1\d{9}(?:\.\d{1,12}|\d{3}|\d{6}|\d{9})?"


def _keys(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


# Order matters: the first alternative that matches gives the token its class.
_TOKENS = (
    ("SP", r"[ \t\r\n]+"),
    ("ISO", _iso + r"(?![\w])"),
    ("CLF", rf"\d\d/(?:{_month})/\d{{4}}:\d\d:\d\d:\d\d(?: [+-]\d{{4}})?"),
    ("US", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d(?:[.,]\d{1,12})?(?: ?[AaPp][Mm])?(?![\w])"),
    ("DOT", r"\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d\d:\d\d(?:[.,]\d{1,12})?(?![\w])"),
    ("MON", rf"(?:{_month}) {{1,2}}\d{{1,2}} \d\d:\d\d:\d\d(?:[.,]\d{{1,12}})?(?![\w])"),
    ("GLOG", r"[DIWEF]\d{4} \d\d:\d\d:\d\d(?:\.\d{1,12})?(?![\w])"),
    ("EPOCH", _epoch + r"(?![\w.])"),
    ("ZONE", rf"[+-]\d\d:?\d\d(?!\w)|(?:{'|'.join(ZONE_HOURS)})(?![\w.])"),
    ("PRI", r"<\d{1,3}>"),
    ("jT", rf'"{_keys(TIME_KEYS)}"\s*:'),
    ("jL", rf'"{_keys(LEVEL_KEYS)}"\s*:'),
    ("jC", rf'"{_keys(WRITER_KEYS)}"\s*:'),
    ("jM", rf'"{_keys(TEXT_KEYS)}"\s*:'),
    ("jO", r'"(?:[^"\\]|\\.)*"\s*:(?=\s*["\d\[{tfn-])'),
    ("qISO", rf'"{_iso}"'),
    ("qEPOCH", rf'"{_epoch}"'),
    ("qLVL", rf'"(?i:{_level}|[diwef])"'),
    ("Q", r'"(?:[^"\\]|\\.)*"'),
    ("kT", rf"(?i:{_keys(TIME_KEYS)})="),
    ("kL", rf"(?i:{_keys(LEVEL_KEYS)})="),
    ("kC", rf"(?i:{_keys(WRITER_KEYS)})="),
    ("kM", rf"(?i:{_keys(TEXT_KEYS)})="),
    ("kO", r"[A-Za-z_][\w.]*="),
    ("LVL", rf"(?i:{_level})(?![\w.-])|[DIWEF](?![\w.:-])"),
    ("W", r'(?:[^\s\[\]|;"{}<>()=,:]|:(?=[^\s"]))+'),
    ("MARK", r"[\[\]|;{}<>()=,:\"]"),
)
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS), re.ASCII)


def _r(left: str, right: str, weight: float = 0.0, **captures: int) -> Rule:
    return Rule(left, tuple(right.split()), weight, tuple(sorted((p, n) for n, p in captures.items())))


def _grammar() -> list[Rule]:
    """Header layouts.  A recognised time counts 10, level 3, writer 3, text 1."""
    rules = [
        # header layouts of plain lines
        _r("entry", f"PRI MON W tag {ANY}", 14.0, pri=0, time=1, text=4),
        _r("entry", f"MON W tag {ANY}", 11.0, time=0, text=3),
        _r("entry", f"PRI MON W {ANY}", 11.0, pri=0, time=1, text=3),
        _r("entry", f"MON {ANY}", 10.0, time=0, text=1),
        _r("entry", f"PRI MON {ANY}", 10.5, pri=0, time=1, text=2),
        _r("entry", f"PRI W ISO W W W W {ANY}", 17.0, pri=0, time=2, writer=4, text=7),
        _r("entry", f"PRI W ISO {ANY}", 12.0, pri=0, time=2, text=3),
        _r("entry", f"ISO [ {ANY}", 10.2, time=0, text=1),
        _r("entry", f"ISO box LVL W {ANY}", 17.0, time=0, level=2, writer=3, text=4),
        _r("entry", f"ISO LVL W {ANY}", 16.5, time=0, level=1, writer=2, text=3),
        _r("entry", f"ISO LVL box W {ANY}", 16.7, time=0, level=1, writer=3, text=4),
        _r("entry", f"ISO {ANY}", 10.0, time=0, text=1),
        _r("entry", f"GLOG num src ] {ANY}", 17.0, glog=0, text=4),
        _r("entry", f"GLOG {ANY}", 12.0, glog=0, text=1),
        _r("entry", f"W W W [ CLF ] {ANY}", 11.0, time=4, text=6),
        _r("entry", f"[ CLF ] {ANY}", 10.5, time=1, text=3),
        _r("entry", f"EPOCH | LVL | W | {ANY}", 17.0, time=0, level=2, writer=4, text=6),
        _r("entry", f"EPOCH | W | LVL | {ANY}", 17.0, time=0, writer=2, level=4, text=6),
        _r("entry", f"EPOCH | {ANY}", 10.5, time=0, text=2),
        _r("entry", f"EPOCH {ANY}", 10.0, time=0, text=1),
        _r("entry", f"LVL stamp W : {ANY}", 17.0, level=0, writer=2, text=4),
        _r("entry", f"LVL stamp {ANY}", 13.0, level=0, text=2),
        _r("entry", f"[ ISO ] [ LVL ] [ W ] {ANY}", 17.0, time=1, level=4, writer=7, text=9),
        _r("entry", f"[ ISO ] [ W ] [ LVL ] {ANY}", 17.0, time=1, writer=4, level=7, text=9),
        _r("entry", f"[ ISO ] [ LVL ] {ANY}", 14.0, time=1, level=4, text=6),
        _r("entry", f"[ ISO ] [ W ] {ANY}", 13.5, time=1, writer=4, text=6),
        _r("entry", f"[ ISO ] {ANY}", 10.5, time=1, text=3),
        _r("entry", f"US pairs kM {ANY}", 11.0, time=0, text=3),
        _r("entry", f"US kM {ANY}", 11.0, time=0, text=2),
        _r("entry", f"US {ANY}", 10.0, time=0, text=1),
        _r("entry", f"DOT < LVL > W : {ANY}", 17.0, time=0, level=2, writer=4, text=6),
        _r("entry", f"DOT ; W ; LVL ; {ANY}", 17.0, time=0, writer=2, level=4, text=6),
        _r("entry", f"DOT ; LVL ; W ; {ANY}", 17.0, time=0, level=2, writer=4, text=6),
        _r("entry", f"DOT ; W ; {ANY}", 13.5, time=0, writer=2, text=4),
        _r("entry", f"DOT {ANY}", 10.0, time=0, text=1),
        # whole-line layouts of named fields
        _r("entry", "pairs", 0.5),
        _r("entry", "object", 0.5),
        # the same with an odd tail: what was read before it stays
        _r("entry", f"pairs {ANY}", 0.3, tail=1),
        _r("entry", f"{{ members {ANY}", 0.3, tail=2),
        # what is no header of its own
        _r("entry", f"TAB {ANY}", 0.2, more=1),
        _r("entry", f"{ANY}", 0.0, rest=0),
        _r("tag", "W [ W ] :", 3.0, writer=0),
        _r("tag", "W :", 3.0, writer=0),
        _r("box", "[ words ]"),
        _r("words", "word"),
        _r("words", "words word"),
        _r("word", "W"),
        _r("word", "LVL"),
        _r("num", "W"),
        _r("src", "W", 3.0, writer=0),
        _r("stamp", "ISO", 10.0, time=0),
        _r("stamp", "ISO ZONE", 10.2, time=0, zone=1),
        _r("pairs", "pair"),
        _r("pairs", "pairs pair"),
        _r("pair", "kT moment"),
        _r("pair", "kL rank"),
        _r("pair", "kC name"),
        _r("pair", "kM said"),
        _r("pair", "kO scalar", 0.1),
        _r("object", "{ members }"),
        _r("members", "member"),
        _r("members", "members , member"),
        _r("member", "jT moment"),
        _r("member", "jL rank"),
        _r("member", "jC name"),
        _r("member", "jM said"),
        _r("member", "jO scalar", 0.1),
        _r("member", "jO object", 0.1),
        _r("member", "jO list", 0.1),
        _r("list", "[ ]"),
        _r("list", "[ elements ]"),
        _r("elements", "element"),
        _r("elements", "elements , element"),
        _r("element", "scalar"),
        _r("element", "object"),
        _r("element", "list"),
        _r("moment", "ISO", 10.0, time=0),
        _r("moment", "qISO", 10.0, time=0),
        _r("moment", "EPOCH", 10.0, time=0),
        _r("moment", "qEPOCH", 10.0, time=0),
        _r("rank", "LVL", 3.0, level=0),
        _r("rank", "qLVL", 3.0, level=0),
        _r("rank", "W"),
        _r("rank", "Q"),
        _r("name", "W", 3.0, writer=0),
        _r("name", "Q", 3.0, writer=0),
        _r("name", "LVL", 3.0, writer=0),
        _r("name", "qLVL", 3.0, writer=0),
    ]
    rules += [_r("said", t, 1.0, text=0) for t in ("Q", "qLVL", "qISO", "qEPOCH", "W", "LVL")]
    rules += [_r("scalar", t) for t in ("W", "Q", "LVL", "qLVL", "qISO", "qEPOCH", "ISO", "EPOCH", "ZONE")]
    return rules


GRAMMAR = _grammar()


class Parsed(NamedTuple):
    time: str | None
    level: str
    component: str
    message: str | None
    unparsed: str | None
    score: float


_parser: WeightedEarley | None = None
_PROCESS_ID = re.compile(r"\[\d+\]$")
_LEADER = re.compile(r"\A\s*(?:[-:]\s+)?")
_LINE_NUMBER = re.compile(r":\d+$")


def _shared_parser() -> WeightedEarley:
    global _parser
    if _parser is None:
        _parser = WeightedEarley(GRAMMAR, "entry")
    return _parser


def parse_line(raw: str | None) -> Parsed | None:
    """Fields of one raw entry; None for null and blank text.

    ``time`` is the written time (with its zone, if one follows), None where
    the text states none: such text begins no entry.  ``level`` is one of
    DEBUG, INFO, WARN, ERROR, FATAL or ''.  ``unparsed`` is what the best parse
    doesn't account for.
    """
    if raw is None or not raw.strip():
        return None
    parser = _shared_parser()
    node = parser.begin()
    spans: list[tuple[int, int]] = []
    if raw[0] in " \t":
        node = node.children.get("TAB") or parser.child(node, "TAB")
        spans.append((0, 0))
    for m in _LEX.finditer(raw):
        kind = m.lastgroup
        if kind == "SP":
            continue
        if kind == "MARK":
            kind = m.group()
        spans.append(m.span())
        node = node.children.get(kind) or parser.child(node, kind)
        if node.saturated:
            break
    best = parser.judge(node)
    if best is None:
        return Parsed(None, "", "", None, raw, 0.0)
    score, rule, caps = best
    time = level = zone = pri = text = writer = left = None
    for name, at in caps:
        a, b = spans[at] if at < len(spans) else (len(raw), len(raw))
        if name == "time":
            time = time or raw[a:b].strip('"')
        elif name == "level":
            level = level or LEVEL_OF[raw[a:b].strip('"').lower()]
        elif name == "writer":
            writer = writer or raw[a:b].strip('"')
        elif name == "zone":
            zone = raw[a:b]
        elif name == "pri":
            pri = int(raw[a + 1 : b - 1])
        elif name == "glog":
            level, time = LEVEL_OF[raw[a].lower()], raw[a:b]
        elif name == "text":
            text = text or (raw[a:b].strip('"') if raw[a : a + 1] == '"' and raw[b - 1] == '"' and b - a > 1 else raw[a:])
        elif name in ("more", "rest"):
            left = raw
        elif name == "tail":
            left = raw[a:]
    if time is None:
        return Parsed(None, "", "", None, raw, score)
    if GRAMMAR[rule].right[-1] != ANY:  # reading stopped at the end of what it covers
        left = raw[spans[-1][1] :].strip() or None
    if left is not None and text is not None and raw.endswith(text) and text.endswith(left):
        left = None  # an unquoted text goes on to the end of the row
    if text is None and left is None and node.saturated and GRAMMAR[rule].right[-1] == ANY:
        text = raw[spans[-1][1] :]
    if text is not None:
        text = _LEADER.sub("", text)
    if zone:
        time = f"{time} {zone}"
    if level is None and pri is not None:
        level = PRIORITY_LEVELS[pri % 8]
    component = _LINE_NUMBER.sub("", _PROCESS_ID.sub("", writer or ""))
    return Parsed(time, level or "", "" if component == "-" else component, text, left, score)
