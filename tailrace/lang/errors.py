"""Errors of the query language, with the place in the text."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, message: str, text: str = "", at: int = 0):
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {self.line}, column {self.column})" if text else message)


class QuerySyntaxError(QueryError):
    """The text is no query."""


class QuerySemanticError(QueryError):
    """The query can't be meant as it stands."""
