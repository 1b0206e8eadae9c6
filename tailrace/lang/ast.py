"""Syntax tree of a piped query: a chain of commands over expressions."""

from __future__ import annotations

from dataclasses import dataclass

# --- expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: str | int | float | bool | None


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    """Arithmetic (+ - * / %), concatenation (.) and comparison (= != < <= > >=)."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class In:
    operand: object
    values: tuple


@dataclass(frozen=True)
class Like:
    operand: object
    pattern: object


# --- conditions of a search ----------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A bare word: matches a token of the raw text; may hold ``*``."""

    text: str


@dataclass(frozen=True)
class Phrase:
    """A quoted text: matches any part of the raw text, whatever its case."""

    text: str


@dataclass(frozen=True)
class Match:
    """``field op value``; ``*`` in the value of ``=`` and ``!=`` stands for any text."""

    field: str
    op: str
    value: str | int | float


# --- commands ------------------------------------------------------------------


@dataclass(frozen=True)
class Search:
    condition: object | None = None
    indexes: tuple[str, ...] = ()
    earliest: str | None = None
    latest: str | None = None


@dataclass(frozen=True)
class Where:
    condition: object


@dataclass(frozen=True)
class Aggregate:
    func: str
    arg: object | None
    name: str


@dataclass(frozen=True)
class Stats:
    aggregates: tuple[Aggregate, ...]
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Timechart:
    aggregates: tuple[Aggregate, ...]
    span: str | None = None
    by: str | None = None


@dataclass(frozen=True)
class Table:
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Fields:
    fields: tuple[str, ...]
    exclude: bool = False


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]
    limit: int | None = None


@dataclass(frozen=True)
class Head:
    n: int = 10


@dataclass(frozen=True)
class Tail:
    n: int = 10


@dataclass(frozen=True)
class Eval:
    assignments: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Dedup:
    fields: tuple[str, ...]
    n: int = 1


@dataclass(frozen=True)
class Rename:
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Rex:
    pattern: str
    field: str = "_raw"


@dataclass(frozen=True)
class Query:
    commands: tuple
