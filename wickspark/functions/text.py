"""A few lines that turn Python operators into SQL text.

Hundreds of Column calls cost seconds of driver time in the Python-JVM bridge; one parsed text per
pattern costs milliseconds.  The result is handed to `F.expr` / `selectExpr`.
"""

from __future__ import annotations


class Sql:
    def __init__(self, text: object):
        self.text = text.text if isinstance(text, Sql) else str(text)

    def __str__(self) -> str:
        return self.text

    def _join(self, op: str, other: object) -> "Sql":
        return Sql(f"({self.text} {op} {Sql(other).text})")

    def __add__(self, other): return self._join("+", other)
    def __sub__(self, other): return self._join("-", other)
    def __mul__(self, other): return self._join("*", other)
    def __truediv__(self, other):
        """Division; null instead of an error where the divisor is a zero price."""
        return self._join("/", call("nullif", other, 0) if isinstance(other, Sql) else other)

    def __lt__(self, other): return self._join("<", other)
    def __le__(self, other): return self._join("<=", other)
    def __gt__(self, other): return self._join(">", other)
    def __ge__(self, other): return self._join(">=", other)
    def __eq__(self, other): return self._join("=", other)
    def __ne__(self, other): return self._join("<>", other)
    def __and__(self, other): return self._join("AND", other)
    def __or__(self, other): return self._join("OR", other)
    def __neg__(self): return Sql(f"(- {self.text})")
    def __invert__(self): return Sql(f"(NOT {self.text})")
    __hash__ = None


def call(name: str, *args: object) -> Sql:
    return Sql(f"{name}({', '.join(str(a) for a in args)})")


def case(*pairs: tuple[object, object], other: object = 0) -> Sql:
    arms = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    return Sql(f"(CASE {arms} ELSE {other} END)")
