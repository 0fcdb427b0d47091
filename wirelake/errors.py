"""Errors that users of the engine see."""

from __future__ import annotations


class WirelakeError(Exception):
    """Base of the engine's errors."""


class QuerySyntaxError(WirelakeError):
    """A query that cannot be read; says where and, if it can, what to write."""

    def __init__(self, message: str, source: str = "", start: int | None = None, end: int | None = None, hint: str = "") -> None:
        self.message, self.hint = message, hint
        self.start, self.end = start, end
        self.line = self.column = None
        shown = message
        if start is not None:
            begin = source.rfind("\n", 0, start) + 1
            stop = source.find("\n", start)
            stop = len(source) if stop < 0 else stop
            self.line, self.column = source.count("\n", 0, start) + 1, start - begin + 1
            lo = max(begin, start - 60)
            hi = min(stop, lo + 120)
            text = "".join(c if c.isprintable() else "\N{REPLACEMENT CHARACTER}" for c in source[lo:hi])
            width = max(1, min(end or start, hi) - start)
            shown += f"\n  line {self.line}, column {self.column}:\n  {text}\n  {' ' * (start - lo)}{'^' * width}"
        super().__init__(shown + (f"\n  {hint}" if hint else ""))


class DecodeError(WirelakeError):
    """Bytes that are not what they should be; ``code`` names the kind."""

    def __init__(self, code: str, message: str) -> None:
        self.code = code
        super().__init__(f"{code}: {message}")


class StoreError(WirelakeError):
    """A store that cannot be read or written as asked."""
