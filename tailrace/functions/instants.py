"""Written times and numbers in unknown units -> one instant in microseconds.

All of it is column expressions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and hours to UTC of zone abbreviations.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ZONE_HOURS = {
    "UTC": 0.0,
    "GMT": 0.0,
    "WEST": 1.0,
    "WET": 0.0,
    "BST": 1.0,
    "CEST": 2.0,
    "CET": 1.0,
    "EEST": 3.0,
    "EET": 2.0,
    "MSK": 3.0,
    "IST": 5.5,
    "JST": 9.0,
    "KST": 9.0,
    "AWST": 8.0,
    "ACST": 9.5,
    "ACDT": 10.5,
    "AEST": 10.0,
    "AEDT": 11.0,
    "NZST": 12.0,
    "NZDT": 13.0,
    "EST": -5.0,
    "EDT": -4.0,
    "CST": -6.0,
    "CDT": -5.0,
    "MST": -7.0,
    "MDT": -6.0,
    "PST": -8.0,
    "PDT": -7.0,
}

_MON = "|".join(MONTHS)
_FRACTION = r"(?:[.,](\d{1,12}))?"
_OFFSET = r"(?: ?(Z|[+-]\d\d:?\d\d)(?!\d)| (" + "|".join(ZONE_HOURS) + r")(?![\w.]))?"
_CLOCK = r"(\d{1,2}):(\d\d):(\d\d)" + _FRACTION

# name -> (pattern, group numbers of the parts)
LAYOUTS: dict[str, tuple[str, dict[str, int]]] = {
    "iso": (
        r"(?<!\d)(\d{4})-(\d\d)-(\d\d)[T ]" + _CLOCK + _OFFSET,
        {"y": 1, "m": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "off": 8, "abbr": 9},
    ),
    "log": (
        rf"(?<!\d)(\d\d)/({_MON})/(\d{{4}}):" + _CLOCK + _OFFSET,
        {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "off": 8, "abbr": 9},
    ),
    "slash": (
        r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4}) " + _CLOCK + r"(?: ?([AaPp])[Mm])?" + _OFFSET,
        {"m": 1, "d": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "half": 8, "off": 9, "abbr": 10},
    ),
    "dots": (
        r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4}) " + _CLOCK + _OFFSET,
        {"d": 1, "m": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "off": 8, "abbr": 9},
    ),
    "month": (
        rf"(?<![A-Za-z])({_MON}) {{1,2}}(\d{{1,2}}) " + _CLOCK + _OFFSET,
        {"mon": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "f": 6, "off": 7, "abbr": 8},
    ),
    "short": (
        r"(?<!\w)[DIWEF](\d\d)(\d\d) " + _CLOCK + r"(?!\w)",
        {"m": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "f": 6},
    ),
    "number": (
        r"(?<![\w./-])(1\d{9})(?:\.(\d{1,12})|(\d{3}|\d{6}|\d{9}))?(?![\w.])",
        {"n": 1, "f": 2, "rest": 3},
    ),
}


def _ungrouped(pattern: str) -> str:
    """``pattern`` with its capturing groups made non-capturing."""
    out, escaped = [], False
    for k, ch in enumerate(pattern):
        out.append(ch)
        if ch == "(" and not escaped and pattern[k + 1 : k + 2] != "?":
            out.append("?:")
        escaped = ch == "\\" and not escaped
    return "".join(out)


#: Written dates are looked for before bare numbers.
DATE_PATTERN = "|".join(_ungrouped(p) for k, (p, _) in LAYOUTS.items() if k != "number")
NUMBER_PATTERN = _ungrouped(LAYOUTS["number"][0])


def time_text(raw: Column) -> Column:
    """The part of ``raw`` that states a time, zone included; '' if none does, null for null."""
    dated = F.regexp_extract(raw, f"({DATE_PATTERN})", 1)
    return F.when(dated != "", dated).otherwise(F.regexp_extract(raw, f"({NUMBER_PATTERN})", 1))


def micros_of_number(n: Column) -> Column:
    """A count of seconds, milli-, micro- or nanoseconds since 1970, told apart by
    size, in microseconds (cut off)."""
    return (
        F.when(n < 10**11, n * 1_000_000)
        .when(n < 10**14, n * 1_000)
        .when(n < 10**17, n)
        .otherwise(F.call_function("div", n, F.lit(1_000)))
        .cast("long")
    )


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


#: Parts of a written time, in the order of its canonical form.
PARTS = ("y", "m", "mon", "d", "h", "mi", "s", "f", "half", "off", "abbr", "n", "rest")
_BAR = "|"


def canonical(text: Column) -> Column:
    """The parts of ``text`` by the first layout it fits, joined by bars in the order
    of PARTS; null where none fits."""
    forms = []
    for pattern, groups in LAYOUTS.values():
        template = _BAR.join(f"${groups[k]}" if k in groups else "" for k in PARTS)
        if "n" in groups:
            template = _BAR.join({"n": "$1", "f": "$2", "rest": "$3"}.get(k, "") for k in PARTS)
        forms.append(F.when(text.rlike(f"^{pattern}"), F.regexp_replace(text, f"(?s)^{pattern}.*$", template)))
    return F.coalesce(*forms)


def written_instants(text: Column, zone: Column, year: Column) -> Column:
    """Instants that ``text`` (see :func:`time_text`) may state, by the first layout it
    fits: one, or for a text without a year those of the year before, the year
    and the year after.

    ``zone`` is the wall clock where the text names no zone; a time it showed
    twice counts as the earlier instant.  ``year`` is that of the receipt and
    is only used for texts without one.  Null where no layout fits.
    """

    def instants(parts: Column) -> Column:
        of = {k: parts[i] for i, k in enumerate(PARTS)}
        number = lambda k: of[k].try_cast("int")
        micros = lambda k: F.rpad(F.substring(of[k], 1, 6), 6, "0").try_cast("long")
        fraction = F.coalesce(micros("f"), F.lit(0).cast("long"))
        counted = of["n"].try_cast("long") * 1_000_000 + F.when(of["rest"] != "", micros("rest")).otherwise(fraction)
        half = F.upper(of["half"])
        hour = F.when(half == "P", number("h") % 12 + 12).when(half == "A", number("h") % 12).otherwise(number("h"))
        month = F.coalesce(number("m"), F.try_element_at(_lookup({m: k + 1 for k, m in enumerate(MONTHS)}), of["mon"]))
        minutes = F.substring(of["off"], 2, 2).try_cast("long") * 60 + F.substring(of["off"], -2, 2).try_cast("long")
        named = F.try_element_at(_lookup({z: int(h * 60) for z, h in ZONE_HOURS.items()}), of["abbr"])
        offset = F.when(of["off"] == "Z", 0).when(of["off"].startswith("-"), -minutes).when(of["off"] != "", minutes).otherwise(named).cast("long")

        def instant(y: Column) -> Column:
            clock = F.unix_micros(F.try_make_timestamp(y, month, number("d"), hour, number("mi"), number("s").cast("decimal(16,6)"), F.lit("UTC")))
            wall = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(clock), zone))
            return F.when(offset.isNotNull(), clock - offset * 60_000_000).otherwise(wall) + fraction

        years = F.when(of["y"] != "", F.array(number("y"))).otherwise(F.array(year - 1, year, year + 1))
        return F.when(of["n"] != "", F.array(counted)).otherwise(F.transform(years, instant))

    # A lambda binds the parts, so the patterns run once.
    return F.transform(F.array(F.split(canonical(text), r"\|", -1)), instants)[0]


def nearest(instants: Column, to_us: Column) -> Column:
    """The one of ``instants`` next to ``to_us`` (the earlier on a tie); null if there
    is none, or several and ``to_us`` is null."""
    known = F.filter(instants, lambda x: x.isNotNull())
    return F.when(F.size(known) <= 1, F.try_element_at(known, F.lit(1))).when(
        to_us.isNotNull(),
        F.array_min(F.transform(known, lambda x: F.struct(F.abs(x - to_us).alias("far"), x.alias("at")))).getField("at"),
    )
