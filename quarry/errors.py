"""Errors of the engine."""

from __future__ import annotations


class SqlError(Exception):
    """An error in a statement: kind is lexical, syntactic, semantic, constraint, transaction or lock."""

    def __init__(self, kind: str, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{kind} error" + f" at {line}:{column}" * bool(line) + f": {message}")
        self.kind, self.message, self.line, self.column = kind, message, line, column
