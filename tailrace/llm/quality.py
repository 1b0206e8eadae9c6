"""Per-document text quality statistics (problem 10).

Long documents are cut into chunks.  A chunk is summarised as a *state*: counts
over the lines that lie wholly inside it, and the open line at either end, kept
as partial counts with what is cut at its edges: the word there (as text, or as
length, hash and the few traits that count if it is long), the run of blanks,
and the characters in which a short pattern may be severed.  Joining two
neighbouring states closes the line and the word between them; the operation is
associative and states have a bounded size, so they are merged in a tree and a
document of any length gives the same figures as if it had been read in one
piece.  Ratios and rule outcomes are derived from the merged counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.io import saved

#: Characters of a chunk, and neighbouring chunks merged by one task at a time.
CHUNK = 50_000
FAN_IN = 16
#: Most words that the list of common words may have: it is held by every worker.
MAX_COMMON = 1_000_000
#: Words (with a letter or digit) back to which endless repetition is looked for.
LAGS = 4
#: Of a longer word, this many characters and some traits count.
LONG_WORD = 128
#: The first and last characters of a line by which its kind is told; no pattern that is
#: counted in place is as long.
EDGE = 64

SHAPES = ("prose", "list", "table", "junk")

# Additive counts of a line.
COUNTS = ("chars", "blanks", "letters", "vowels", "digits", "words", "common", "hexes", "long_chars", "damaged", "pipes", "tabs", "semicolons", "commas", "gaps", "cells", "percents", "ticks")
CHARS, BLANKS, LETTERS, VOWELS, DIGITS, WORDS, COMMON, HEXES, LONG_CHARS, DAMAGED, PIPES, TABS, SEMICOLONS, COMMAS, GAPS, CELLS, PERCENTS, TICKS = range(len(COUNTS))

_BREAK = re.compile(r"\r\n|\r|\n")
_BULLET = re.compile(r"\s*(?:\[[ xX]?\]|[-*+•◦▪‣·–]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
_RULE = re.compile(r"[\s|+=:_\-]{3,}\Z")
_CELL_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_GAP = re.compile(r"\S {2,}(?=\S)")
_HEX = re.compile(r"(?:[0-9a-f]{2}|[0-9a-f]{4}|[0-9a-f]{8,})\Z", re.I)
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_VOWELS = frozenset("aeiouyáàâäãéèêëíìîïóòôöõúùûüýAEIOUYÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝ")
_DAMAGE = re.compile("[ÃÂ][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€|\ufffd|[\u0000-\u0008\u000e-\u001f\u007f]")
_END = ".!?…。！？"
_CLOSERS = "\"'”’»)]*_`"


# --- words --------------------------------------------------------------------

_FIELD = 15
_ONE = (1 << _FIELD) - 1
_PRIME = (1 << 127) - 1


class Word:
    """A word or a part of one: its text while it is short, and what counts of it if it is long."""

    __slots__ = ("n", "head", "last", "hash", "core", "rule", "angle", "marks", "link")

    def __init__(self, text: str = ""):
        self.n = len(text)
        self.head = text[:LONG_WORD]
        self.last = text[-2:]
        self.hash = int.from_bytes(text.encode("utf-32-le", "surrogatepass"), "little") % _PRIME
        self.core = _CORE.search(text) is not None
        self.rule = not text.strip("|+=:_-")
        self.angle = "<" in text
        self.marks = text.count("|") + text.count(",") + text.count(";")
        self.link = "://" in text

    def __add__(self, b: Word) -> Word:
        r = Word()
        r.n = self.n + b.n
        r.head = (self.head + b.head)[:LONG_WORD] if self.n < LONG_WORD else self.head
        r.last = (self.last + b.last)[-2:]
        r.hash = (self.hash + b.hash * pow(2, 32 * self.n, _PRIME)) % _PRIME
        r.core, r.rule, r.angle = self.core or b.core, self.rule and b.rule, self.angle or b.angle
        r.marks, r.link = self.marks + b.marks, self.link or b.link or "://" in self.last + b.head[:2]
        return r

    def key(self) -> str:
        """What tells the word from others."""
        return self.head if self.n <= LONG_WORD else f"\0{self.n} {self.hash:x}"

    def value(self, common: frozenset) -> int:
        """common, hexes, longs and whether it has a letter or digit, packed."""
        is_common = longs = hexes = 0
        core = _CORE.search(self.head) if self.core else None
        if core is not None:
            w = core.group().lower()
            is_common = int(w in common or "'" in w and w.split("'", 1)[0] in common)
        if self.n > 30:
            longs = int(not self.rule and not self.angle and self.marks < 2 and not self.link and self.head[0] != "/")
        elif self.n >= 2 and _HEX.match(self.head) and (not self.head.isalpha() or self.n == 2 and self.head.islower()):
            hexes = 1
        return is_common | hexes << _FIELD | longs << 2 * _FIELD | self.core << 3 * _FIELD


class _Words(dict):
    """Word -> :meth:`Word.value`; emptied when it has grown too large."""

    def __init__(self, common: frozenset):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        packed = Word(word).value(self.common)
        if len(word) <= 64:
            self[word] = packed
        return packed


_memos: dict[frozenset, _Words] = {}


def _words_of(common: frozenset) -> _Words:
    if common not in _memos:
        _memos.clear()
        _memos[common] = _Words(common)
    return _memos[common]


def _add_words(words: list[str], c: list, memo: _Words) -> None:
    """Adds whole words (runs without white space) to the counts."""
    if len(words) > _ONE:
        for k in range(0, len(words), _ONE):
            _add_words(words[k : k + _ONE], c, memo)
        return
    c[WORDS] += len(words)
    packed = sum(map(memo.__getitem__, words))
    c[COMMON] += packed & _ONE
    c[HEXES] += packed >> _FIELD & _ONE
    if packed >> 2 * _FIELD & _ONE:
        c[LONG_CHARS] += sum(len(w) for w in words if len(w) > 30 and memo[w] >> 2 * _FIELD & 1)


def _add_cut(w: Word, c: list, common: frozenset) -> None:
    packed = w.value(common)
    c[WORDS] += 1
    c[COMMON] += packed & _ONE
    c[HEXES] += packed >> _FIELD & _ONE
    if packed >> 2 * _FIELD & _ONE:
        c[LONG_CHARS] += w.n


# --- characters ---------------------------------------------------------------

_SUSPECTS = frozenset("ÃÂâ\ufffd\x7f") | {chr(x) for x in (*range(9), *range(14, 32))}
_tables: list[np.ndarray] = []


def _char_tables() -> list[np.ndarray]:
    """Packed marks (16 bits each) of the characters below 2**16: letters, blanks, vowels
    and digits; pipes, tabs, semicolons and commas; ticks, '<', '%' and suspects of damage."""
    if not _tables:
        chars = [chr(x) for x in range(1 << 16)]
        tests = (
            (str.isalpha, str.isspace, _VOWELS.__contains__, str.isdigit),
            ("|".__eq__, "\t".__eq__, ";".__eq__, ",".__eq__),
            ("`".__eq__, "<".__eq__, "%".__eq__, _SUSPECTS.__contains__),
        )
        for four in tests:
            _tables.append(sum(np.array([bool(t(x)) for x in chars], np.uint64) << np.uint64(16 * k) for k, t in enumerate(four)))
    return _tables


_LONGEST = 60_000


def _line_counts(lines: list[str]) -> list[list[int]]:
    """For each line the sums of the marks of :func:`_char_tables`."""
    if max(map(len, lines), default=0) > _LONGEST:
        out = []
        for x in lines:
            pieces = _line_counts([x[k : k + _LONGEST] for k in range(0, len(x), _LONGEST)] or [""])
            out.append([sum(v) for v in zip(*pieces)])
        return out
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(lines), np.int64)
    np.cumsum([len(x) + 1 for x in lines[:-1]], out=starts[1:])
    wide = np.nonzero(codes >= 1 << 16)[0]
    if len(wide):
        codes = np.minimum(codes, (1 << 16) - 1)
    columns = []
    for k, t in enumerate(_char_tables()):
        sums = np.add.reduceat(t[codes], starts)
        if k == 0:
            sums -= np.uint64(1 << 16)  # the line feed that was added
        columns += [(sums >> np.uint64(16 * j) & np.uint64(0xFFFF)).tolist() for j in range(4)]
    out = list(map(list, zip(*columns)))
    for at, line in zip(wide.tolist(), (np.searchsorted(starts, wide, "right") - 1).tolist()):
        ch = lines[line][at - int(starts[line])]
        out[line][0] += ch.isalpha()
        out[line][3] += ch.isdigit()
    return out


def _counts_of(line: str, marks: list[int]) -> list:
    """All counts of a line but those of its words."""
    letters, blanks, vowels, digits, pipes, tabs, semicolons, commas, ticks, angles, percents, suspects = marks
    damaged = sum(map(len, _DAMAGE.findall(line))) if suspects else 0
    gaps = len(_GAP.findall(line)) if "  " in line else 0
    cells = len(_CELL_TAG.findall(line)) if angles else 0
    if percents:
        percents = len(_PERCENT.findall(line))
    return [len(line), blanks, letters, vowels, digits, 0, 0, 0, 0, damaged, pipes, tabs, semicolons, commas, gaps, cells, percents, ticks]


_PLACED = ((DAMAGED, lambda x: sum(map(len, _DAMAGE.findall(x)))), (CELLS, lambda x: len(_CELL_TAG.findall(x))), (PERCENTS, lambda x: len(_PERCENT.findall(x))))


class Line:
    """A line or a part of one: counts, its edges, and the words cut at them."""

    __slots__ = ("c", "head", "tail", "whole", "first", "last", "gap")

    def __init__(self):
        self.c = [0] * len(COUNTS)
        self.head = Word()  # the word cut at the start; the whole text if there is no white space
        self.tail = Word()  # the word cut at the end
        self.whole = False  # no white space inside: head holds the only, cut, word
        self.first = ""  # the first characters of the part
        self.last = ""  # the last characters of the part
        # blanks only; blanks at the start (2 at most); a word follows them; the same of the end
        self.gap = [True, 0, False, 0, False]


def _gap_edges(text: str) -> list:
    n = len(text)
    inner = text.strip(" ")
    if not inner:
        return [True, min(n, 2), False, 0, False]
    lead, trail = n - len(text.lstrip(" ")), n - len(text.rstrip(" "))
    return [False, min(lead, 2), not inner[0].isspace(), min(trail, 2), not inner[-1].isspace()]


def part(text: str, marks: list[int], words: list[str], common: frozenset, first: bool, last: bool) -> Line:
    """State of a part of a line; ``first``/``last``: it begins/ends the line."""
    p = Line()
    p.c = _counts_of(text, marks)
    p.first, p.last, p.gap = text[:EDGE], text[-EDGE:], _gap_edges(text)
    if not words:
        p.whole = text == ""
        return p
    cut_head = not first and not text[0].isspace()
    cut_tail = not last and not text[-1].isspace()
    if len(words) == 1 and cut_head and cut_tail:
        p.head, p.whole = Word(words[0]), True
        return p
    lo, hi = 0, len(words)
    if cut_head:
        p.head, lo = Word(words[0]), 1
    if cut_tail:
        p.tail, hi = Word(words[-1]), hi - 1
    _add_words(words[lo:hi], p.c, _words_of(common))
    return p


def join_parts(a: Line, b: Line, common: frozenset) -> Line:
    """Two neighbouring parts of a line as one."""
    r = Line()
    r.c = [x + y for x, y in zip(a.c, b.c)]
    if a.last and b.first:
        for k, count in _PLACED:  # these patterns are found in place, whatever stands before them
            r.c[k] += count(a.last + b.first) - count(a.last) - count(b.first)
    (a_only, a_lead, a_after, a_trail, a_before), (b_only, b_lead, b_after, b_trail, b_before) = a.gap, b.gap
    if a_only:
        r.gap = [b_only, min(a_lead + b_lead, 2), b_after, b_trail, b_before]
    elif b_only:
        r.gap = [False, a_lead, a_after, min(a_trail + b_lead, 2), a_before]
    else:
        r.gap = [False, a_lead, a_after, b_trail, b_before]
        r.c[GAPS] += a_trail + b_lead >= 2 and a_before and b_after
    r.first = (a.first + b.first)[:EDGE] if a.c[CHARS] < EDGE else a.first
    r.last = (a.last + b.last)[-EDGE:] if b.c[CHARS] < EDGE else b.last
    if a.whole and b.whole:
        r.head, r.whole = a.head + b.head, True
    elif a.whole:
        r.head, r.tail = a.head + b.head, b.tail
    elif b.whole:
        r.head, r.tail = a.head, a.tail + b.head
    else:
        r.head, r.tail = a.head, b.tail
        middle = a.tail + b.head
        if middle.n:
            _add_cut(middle, r.c, common)
    return r


def close(p: Line, common: frozenset) -> list:
    """Counts of a finished line."""
    for w in (p.head,) if p.whole else (p.head, p.tail):
        if w.n:
            _add_cut(w, p.c, common)
    return p.c


def ends_in_punctuation(last: str) -> bool:
    end = last.rstrip().rstrip(_CLOSERS)
    return bool(end) and end[-1] in _END and not end[:-1].endswith(" ") and len(end) > 1


def line_shape(c: list, first: str, last: str, ended: bool) -> str:
    """prose, list, table, junk or '' (says nothing) for a finished line."""
    chars = c[CHARS] - c[BLANKS]
    words = c[WORDS]
    if chars == 0 or words == 0:
        return ""
    if c[DAMAGED] * 20 >= chars:
        return "junk"
    if c[PERCENTS] >= 3 and c[PERCENTS] * 10 >= chars:
        return "junk"
    if c[LONG_CHARS] * 2 > chars:
        return "junk"
    share = c[COMMON] / words
    if words >= 6 and c[HEXES] >= 6 and c[HEXES] * 10 >= words * 6:
        return "junk"
    if c[CELLS]:
        return "table"
    bullet = _BULLET.match(first) is not None
    if (c[LETTERS] + c[DIGITS]) * 10 < chars * 2:
        return "table" if _RULE.match(last) and chars >= 3 else ("junk" if chars >= 12 else "")
    if (chars - c[LETTERS] - c[DIGITS]) * 2 > chars and c[PIPES] < 2:
        return "junk"
    if words >= 4 and share >= 0.25:
        return "prose"
    gaps = 0 if words >= 10 and c[GAPS] * 10 >= (words - 1) * 7 else c[GAPS]  # wide spacing throughout sets off no cells
    cells = max(c[PIPES] - 1, c[TABS], c[SEMICOLONS], c[COMMAS] if not ended else 0, gaps)
    if (cells >= 2 or c[TABS] or (c[PIPES] >= 2 and first.lstrip()[:1] == "|")) and words <= 3.5 * (cells + 1) and c[TICKS] < 2:
        return "table"
    if words >= 7 and c[LETTERS] * 2 > chars:
        return "prose"
    if ended and not bullet and c[LETTERS] * 2 > chars:
        return "prose"
    if c[GAPS] >= 1 and not bullet and share == 0 and words <= 8:
        return "table"
    if words >= 3 and share > 0 and not bullet and c[LETTERS] * 2 > chars:
        return "prose"
    return "list" if words <= 8 else "prose"


class State:
    """Counts of a run of text: closed lines, open edges, repeated words."""

    __slots__ = ("lines", "nonblank", "ended", "total", "mass", "count", "head", "tail", "repeats", "n_words", "first_words", "last_words")

    def __init__(self):
        self.lines = self.nonblank = self.ended = 0
        self.total = [0] * len(COUNTS)
        self.mass = dict.fromkeys(SHAPES, 0)
        self.count = dict.fromkeys(SHAPES, 0)
        self.head: Line | None = None  # both are None for a whole document
        self.tail: Line | None = None  # None with a head: no line end inside, head is the only part
        self.repeats = [0] * LAGS
        self.n_words = 0
        self.first_words: list[str] = []
        self.last_words: list[str] = []

    def add_line(self, c: list, first: str, last: str) -> None:
        """Takes a closed line."""
        self.tell(c, first, last)
        self.total = list(map(int.__add__, self.total, c))

    def tell(self, c: list, first: str, last: str) -> None:
        """Takes the kind of a closed line, whose counts are added elsewhere."""
        self.lines += 1
        if c[WORDS]:
            self.nonblank += 1
            ended = ends_in_punctuation(last)
            self.ended += ended
            shape = line_shape(c, first, last, ended)
            if shape:
                self.mass[shape] += c[CHARS] - c[BLANKS]
                self.count[shape] += 1


def _repeats(words: list[str]) -> list[int]:
    n = len(words)
    return [sum(map(eq, words, words[k:])) if n > k else 0 for k in range(1, LAGS + 1)]


def _summarise(text: str, lines: list[str], marks: list[list[int]], common: frozenset, starts: bool, ends: bool) -> State:
    s = State()
    memo = _words_of(common)
    value = memo.__getitem__
    closed: list[list] = []
    every: list[str] = []  # words with a letter or digit
    last = len(lines) - 1
    for k, (line, of) in enumerate(zip(lines, marks)):
        words = line.split()
        if (k == 0 or k == last) and not (starts and ends):
            p = part(line, of, words, common, k > 0 or starts, k < last or ends)
            if k == 0:
                s.head = p
            else:
                s.tail = p
            words = [w for w in words if value(w) >> 3 * _FIELD]
        else:
            c = _counts_of(line, of)
            if len(words) > _ONE:
                _add_words(words, c, memo)
                words = [w for w in words if value(w) >> 3 * _FIELD]
            elif words:
                values = list(map(value, words))
                packed = sum(values)
                c[WORDS] = len(words)
                c[COMMON] = packed & _ONE
                c[HEXES] = packed >> _FIELD & _ONE
                if packed >> 2 * _FIELD & _ONE:
                    c[LONG_CHARS] = sum(len(w) for w, v in zip(words, values) if v >> 2 * _FIELD & 1)
                if packed >> 3 * _FIELD != len(words):
                    words = [w for w, v in zip(words, values) if v >> 3 * _FIELD]
            closed.append(c)
            s.tell(c, line[:EDGE], line[-EDGE:])
        every += words if len(line) <= LONG_WORD else [w if len(w) <= LONG_WORD else Word(w).key() for w in words]
    if closed:
        s.total = list(map(sum, zip(*closed)))
    if every:
        # the words cut at the edges are none yet
        lo = 1 if not starts and not text[0].isspace() and _CORE.search(text.split(None, 1)[0]) else 0
        hi = len(every) - 1 if not ends and not text[-1].isspace() and _CORE.search(text.rsplit(None, 1)[-1]) else len(every)
        whole = every[lo:hi] if hi > lo else []
        s.repeats = _repeats(whole)
        s.n_words = len(whole)
        s.first_words, s.last_words = whole[:LAGS], whole[-LAGS:]
    return s


def summarise(text: str, common: frozenset, starts: bool = True, ends: bool = True) -> State:
    """State of a chunk; ``starts``/``ends``: it begins/ends the document.

    A chunk must not be cut between a carriage return and its line feed.
    """
    lines = _BREAK.split(text)
    return _summarise(text, lines, _line_counts(lines), common, starts, ends)


def summarise_all(texts: list[str], common: frozenset) -> Iterator[State]:
    """States of whole texts, whose characters are counted together."""
    lines = [_BREAK.split(t) for t in texts]
    marks = _line_counts([x for of in lines for x in of])
    at = 0
    for t, of in zip(texts, lines):
        yield _summarise(t, of, marks[at : at + len(of)], common, True, True)
        at += len(of)


def merge(a: State, b: State, common: frozenset) -> State:
    """States of two neighbouring runs as one."""
    s = State()
    s.lines, s.nonblank, s.ended = a.lines + b.lines, a.nonblank + b.nonblank, a.ended + b.ended
    s.total = [x + y for x, y in zip(a.total, b.total)]
    s.mass = {k: a.mass[k] + b.mass[k] for k in SHAPES}
    s.count = {k: a.count[k] + b.count[k] for k in SHAPES}
    left, right = a.tail or a.head, b.head
    cut = (left.head if left.whole else left.tail) + right.head
    inner_open = left.whole and a.tail is None or right.whole and b.tail is None
    between = [cut.key()] if cut.n and not inner_open and cut.core else []
    joined = join_parts(left, right, common)
    s.head = a.head if a.tail is not None else joined
    if b.tail is not None:
        s.tail = b.tail
        if a.tail is not None:
            c = close(joined, common)
            s.add_line(c, joined.first, joined.last)
    elif a.tail is not None:
        s.tail = joined
    la, fb = a.last_words, b.first_words
    seq = la + between + fb
    x, y = len(la), len(la) + len(between)
    s.repeats = [p + q for p, q in zip(a.repeats, b.repeats)]
    for lag in range(1, LAGS + 1):
        for i in range(len(seq) - lag):
            if not (i + lag < x or i >= y) and seq[i] == seq[i + lag]:
                s.repeats[lag - 1] += 1
    s.n_words = a.n_words + b.n_words + len(between)
    s.first_words = (a.first_words + between + b.first_words)[:LAGS] if a.n_words < LAGS else a.first_words
    s.last_words = (a.last_words + between + b.last_words)[-LAGS:] if b.n_words < LAGS else b.last_words
    return s


def finish(s: State, common: frozenset) -> State:
    """Closes the edges of a whole document's state."""
    for p in (s.head, s.tail):
        if p is not None:
            s.add_line(close(p, common), p.first, p.last)
    s.head = s.tail = None
    return s


def _dump_word(w: Word) -> list:
    return [w.n, w.head, w.last, f"{w.hash:x}", w.core, w.rule, w.angle, w.marks, w.link]


def _load_word(x: list) -> Word:
    w = Word()
    w.n, w.head, w.last, hashed, w.core, w.rule, w.angle, w.marks, w.link = x
    w.hash = int(hashed, 16)
    return w


def _dump_line(p: Line | None):
    return None if p is None else [p.c, _dump_word(p.head), _dump_word(p.tail), p.first, p.last, p.whole, p.gap]


def _load_line(x) -> Line | None:
    if x is None:
        return None
    p = Line()
    p.c, head, tail, p.first, p.last, p.whole, p.gap = x
    p.head, p.tail = _load_word(head), _load_word(tail)
    return p


def dump(s: State) -> str:
    return json.dumps([s.lines, s.nonblank, s.ended, s.total, s.mass, s.count, _dump_line(s.head), _dump_line(s.tail), s.repeats, s.n_words, s.first_words, s.last_words])


def load(text: str) -> State:
    s = State()
    s.lines, s.nonblank, s.ended, s.total, s.mass, s.count, h, t, s.repeats, s.n_words, s.first_words, s.last_words = json.loads(text)
    s.head, s.tail = _load_line(h), _load_line(t)
    return s


STATS = (
    "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, punctuated_line_share double, common_word_share double, "
    "vowel_share double, repeated_share double, prose_mass double, list_mass double, table_mass double, junk_mass double, shape string"
)


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def shape_of(s: State) -> str:
    """The rule outcome for a finished state; '' for texts without words."""
    t = s.total
    if not t[WORDS]:
        return ""
    repeated = _share(max(s.repeats), s.n_words)
    if s.n_words >= 20 and repeated >= 0.5:
        return "junk"
    mass = dict(s.mass)
    vowels = _share(t[VOWELS], t[LETTERS])
    common = _share(t[COMMON], t[WORDS])
    # letters drawn at random: few vowels, no common words
    if t[LETTERS] >= 60 and vowels < 0.29 and common < 0.02 and t[DIGITS] < t[LETTERS] and mass["table"] * 2 < sum(mass.values()):
        return "junk"
    total = sum(mass.values())
    if not total:
        solid = t[CHARS] - t[BLANKS]
        return "junk" if (solid - t[LETTERS] - t[DIGITS]) * 2 > solid else "prose"
    # one long sentence among short items doesn't make a list prose
    if s.count["list"] >= 3 and s.count["list"] * 10 >= 6 * sum(s.count.values()):
        return "list"
    if mass["prose"] * 2 >= total:
        return "prose"
    return max(("junk", "table", "list"), key=lambda k: mass[k])


def stats_row(s: State) -> tuple:
    t, m = s.total, s.mass
    solid = t[CHARS] - t[BLANKS]
    total = sum(m.values())
    return (
        t[CHARS], t[WORDS], s.nonblank, _share(solid, t[WORDS]), _share(solid - t[LETTERS] - t[DIGITS], solid), _share(t[DIGITS], solid), _share(s.ended, s.nonblank), _share(t[COMMON], t[WORDS]),
        _share(t[VOWELS], t[LETTERS]), _share(max(s.repeats), s.n_words), *(_share(m[k], total) for k in SHAPES), shape_of(s),
    )


def _arrow(spec: str) -> list[pa.DataType]:
    of = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return [of[x.split()[1]] for x in spec.split(", ")]


def common_words(table: DataFrame) -> frozenset:
    """Lower-case words of the list, which must not exceed MAX_COMMON."""
    rows = table.select(F.lower("word").alias("w")).dropna().distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"the list of common words has more than {MAX_COMMON} words")
    return frozenset(r.w for r in rows)


def cut(text: str, chunk: int) -> Iterator[str]:
    """Chunks of ``chunk`` characters; a carriage return goes to the chunk of its line feed."""
    at = 0
    while at < len(text):
        end = min(at + chunk, len(text))
        if end < len(text) and text[end - 1] == "\r" and text[end] == "\n":
            end = end - 1 if end - 1 > at else end + 1
        yield text[at:end]
        at = end


def _columns(rows: list[tuple], spec: str) -> list[pa.Array]:
    kinds = _arrow(spec)
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return [pa.array(list(c), t) for c, t in zip(columns, kinds)]


def statistics(docs: DataFrame, common: frozenset, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, STATS) of each document with text; null texts have no row, blank
    ones count 0 and have the shape ''.

    The texts are read once: those of up to ``chunk`` characters are counted where
    they are read, longer ones are cut there and their chunks are spread over all
    tasks.  What both give is written to the shared folder before it goes on.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    names = [x.split()[0] for x in STATS.split(", ")]
    body = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null")
    shared = spark.sparkContext.broadcast(common)
    spread = f"id {kind}, row_no bigint, n bigint, k bigint, piece string, {STATS}"
    parts = ["row_no", "n", "k", "piece"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        row_no = 0
        for b in batches:
            texts = b.column(1).to_pylist()
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for lo in range(0, len(short), 256):
                some = short[lo : lo + 256]
                rows = [stats_row(finish(s, words)) for s in summarise_all([texts[k] for k in some], words)]
                nothing = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), *nothing, *_columns(rows, STATS)], ["id", *parts, *names])
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    row_no += 1  # with the number of chunks and the id it tells repeated ids apart
                    pieces = list(cut(t, chunk))
                    m = len(pieces)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([k] * m, pa.int64())), pa.array([row_no] * m, pa.int64()), pa.array([m] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array(pieces, pa.string()),
                         *(pa.nulls(m, x) for x in _arrow(STATS))], ["id", *parts, *names],
                    )

    counted = body.mapInArrow(read, spread).withColumn("row_no", F.when(F.col("row_no").isNotNull(), F.struct(F.spark_partition_id().alias("task"), "row_no")))
    counted = saved(counted, "statistics")
    long = counted.filter("k is not null")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            n, k, t = (b.column(i).to_pylist() for i in (2, 3, 4))
            states = [dump(summarise(x, words, j == 0, j == m - 1)) for m, j, x in zip(n, k, t)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(states, pa.string())], ["id", "row_no", "k", "state"])

    key = "row_no struct<task:int,row_no:bigint>"
    states = long.select("id", "row_no", "n", "k", "piece").repartition("id", "row_no", "k").mapInArrow(chunks, f"id {kind}, {key}, k bigint, state string")
    levels, n = 0, long.agg(F.max("n").alias("n")).first().n or 0
    while n > 1:
        levels, n = levels + 1, -(-n // FAN_IN)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            out = []
            for group in b.column(3).to_pylist():
                acc = None
                for x in group:
                    s = load(x["state"])
                    acc = s if acc is None else merge(acc, s, words)
                out.append(dump(acc))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], ["id", "row_no", "k", "state"])

    for _ in range(levels):
        # FAN_IN states, each of bounded size, meet in one row.
        groups = states.groupBy("id", "row_no", F.call_function("div", F.col("k"), F.lit(FAN_IN)).alias("up")).agg(F.sort_array(F.collect_list(F.struct("k", "state"))).alias("states"))
        states = groups.select("id", "row_no", F.col("up").alias("k"), "states").mapInArrow(merged, f"id {kind}, {key}, k bigint, state string")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            rows = [stats_row(finish(load(x), words)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(rows, STATS)], ["id", *names])

    done = counted.filter("k is null").select("id", *names)
    if levels:
        done = done.unionByName(states.select("id", "state").mapInArrow(final, f"id {kind}, {STATS}"))
    return done.withColumnRenamed("id", id_col)


def document_statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    return statistics(docs, common_words(words))


def found(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, shape): documents that for the most part are no running sentences."""
    return document_statistics(docs, words).filter("shape in ('list', 'table', 'junk')").select("doc_id", "shape")
