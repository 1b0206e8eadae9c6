"""Text search and field extraction as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that separate tokens, besides white space.
DELIMITERS = "=,;:\"'[](){}<>"
_SPLIT = r"[\s" + re.escape(DELIMITERS) + r"]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same folding for Python texts.
FOLD = str.maketrans(_UPPER, _UPPER.lower())


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; other letters are left as they are."""
    plain = F.octet_length(text) == F.length(text)  # without other letters the built-in form is the same, and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def tokens(text: Column) -> Column:
    """Tokens of a text in order: lower-cased pieces of at least two bytes between delimiters."""
    return F.filter(F.split(ascii_lower(text), _SPLIT + "+"), lambda t: F.octet_length(t) >= 2)


def has_token(text: Column, term: str, lowered: Column | None = None) -> Column:
    """Whether a token equals ``term`` (A-Z in any case); ``*`` stands for any part of
    a token, alone for every text.  A term that itself holds delimiters must be
    found whole, between delimiters.  ``lowered`` is the text in lower case, where
    it is at hand."""
    if set(term) == {"*"}:
        return F.lit(True)
    inside = "[^\\s" + re.escape(DELIMITERS) + "]*"
    # without further flags this takes A-Z in any case, and no other letters
    hit = text.rlike(f"(?i)(?:^|{_SPLIT}){inside.join(re.escape(p) for p in term.split('*'))}(?:$|{_SPLIT})")
    longest = max(term.split("*"), key=len)
    if longest.isascii():  # a plain search spares most rows the pattern
        hit = (F.lower(text) if lowered is None else lowered).contains(longest.lower()) & hit
    return F.coalesce(hit, F.lit(False))


def has_phrase(text: Column, phrase: str, lowered: Column | None = None) -> Column:
    """Whether ``phrase`` occurs anywhere, in any case."""
    return F.coalesce((F.lower(text) if lowered is None else lowered).contains(phrase.lower()), F.lit(False))


def wildcard_like(pattern: str) -> str:
    """``*`` wildcards as a LIKE pattern."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def extracted(raw: Column, name: str) -> Column:
    """Field ``name`` of a raw text: a top-level member where the text is a JSON
    object, else the last ``name=value`` in it (quoted, or up to a blank, comma or
    semicolon); null if there is none."""
    key = re.escape(name)
    found = F.regexp_extract(raw, rf'(?s)^.*(?:^|[\s,;({{\[|]){key}=("[^"]*"|[^\s,;]+)', 1)
    # most texts don't hold the name at all
    value = F.when(raw.contains(f"{name}="), F.nullif(F.regexp_replace(found, '^"|"$', ""), F.lit("")))
    path = "$['" + name.replace("'", "") + "']"
    member = F.when(raw.contains(f'"{name}"'), F.get_json_object(raw, path))
    return F.when(F.ltrim(raw).startswith("{"), member).otherwise(value)


def extract_map(raw: Column) -> Column:
    """All ``name=value`` pairs of a raw text as a map, the last of a name counting."""
    keys = F.regexp_extract_all(raw, F.lit(r'(\w+)=("[^"]*"|[^\s,;]+)'), F.lit(1))
    values = F.regexp_extract_all(raw, F.lit(r'(\w+)=("[^"]*"|[^\s,;]+)'), F.lit(2))
    entries = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.struct(F.element_at(keys, i).alias("key"), F.regexp_replace(F.element_at(values, i), '^"|"$', "").alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])) == 0)
    return F.when(F.size(keys) > 0, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def bytes_text(n: Column) -> Column:
    """A number of bytes for reading: B, KB, MB or GB with one decimal."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .when(n.isNotNull(), F.format_string("%.1f GB", n / 1024**3))
    )
