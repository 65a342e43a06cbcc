"""Metadata predicates, compiled to expressions that are true or false, never null.

Metadata lives in typed maps: text (strings), floats and ints. A column that a row lacks makes
a leaf false, and so its negation true. NaN compares false with everything.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)

    def column(self, text: str = "text", floats: str = "floats", ints: str = "ints") -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Any(Filter):
    """True for every row; its negation is true for none."""

    def column(self, text="text", floats="floats", ints="ints"):
        return F.lit(True)


@dataclass(frozen=True)
class Equals(Filter):
    name: str
    value: str

    def column(self, text="text", floats="floats", ints="ints"):
        return F.coalesce(F.try_element_at(F.col(text), F.lit(self.name)) == self.value, F.lit(False))


@dataclass(frozen=True)
class In(Filter):
    name: str
    values: frozenset

    def column(self, text="text", floats="floats", ints="ints"):
        if not self.values:
            return F.lit(False)
        return F.coalesce(F.try_element_at(F.col(text), F.lit(self.name)).isin(sorted(self.values)), F.lit(False))


@dataclass(frozen=True)
class _Float(Filter):
    """Looks at the float of that name, else at the int, as a 32-bit float."""

    name: str
    value: float

    def column(self, text="text", floats="floats", ints="ints"):
        bound = F.lit(float(self.value)).cast("float")
        own = F.try_element_at(F.col(floats), F.lit(self.name))
        other = F.try_element_at(F.col(ints), F.lit(self.name)).cast("float")
        found = F.when(own.isNotNull(), own).otherwise(other)
        return F.coalesce(~F.isnan(found) & ~F.isnan(bound) & self._compare(found, bound), F.lit(False))


@dataclass(frozen=True)
class GreaterThan(_Float):
    def _compare(self, a, b):
        return a > b


@dataclass(frozen=True)
class LessThan(_Float):
    def _compare(self, a, b):
        return a < b


@dataclass(frozen=True)
class GreaterThanInt(Filter):
    name: str
    value: int

    def column(self, text="text", floats="floats", ints="ints"):
        return F.coalesce(F.try_element_at(F.col(ints), F.lit(self.name)) > F.lit(self.value).cast("long"), F.lit(False))


@dataclass(frozen=True)
class LessThanInt(Filter):
    name: str
    value: int

    def column(self, text="text", floats="floats", ints="ints"):
        return F.coalesce(F.try_element_at(F.col(ints), F.lit(self.name)) < F.lit(self.value).cast("long"), F.lit(False))


@dataclass(frozen=True)
class And(Filter):
    parts: tuple = ()

    def column(self, text="text", floats="floats", ints="ints"):
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(text, floats, ints)
        return out


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple = ()

    def column(self, text="text", floats="floats", ints="ints"):
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column(text, floats, ints)
        return out


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, text="text", floats="floats", ints="ints"):
        return ~self.part.column(text, floats, ints)


def build(*parts: Filter | None | Iterable) -> Filter:
    """The statements of a block, joined by and; None and Any are dropped, lists are taken apart."""
    flat: list[Filter] = []
    for p in parts:
        if isinstance(p, Filter):
            flat += [] if isinstance(p, Any) else [p]
        elif p is not None:
            inner = build(*p)
            flat += [] if isinstance(inner, Any) else [inner]
    return Any() if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def evaluate(f: Filter, text: dict, floats: dict, ints: dict) -> bool:
    """The same in plain Python, for tests and single rows."""
    import numpy as np

    if isinstance(f, Any):
        return True
    if isinstance(f, Equals):
        return text.get(f.name) == f.value
    if isinstance(f, In):
        return text.get(f.name) in f.values
    if isinstance(f, _Float):
        value = floats.get(f.name)
        if value is None:
            value = ints.get(f.name)
        if value is None:
            return False
        value, bound = np.float32(value), np.float32(f.value)
        return bool(value > bound if isinstance(f, GreaterThan) else value < bound)
    if isinstance(f, GreaterThanInt):
        return f.name in ints and ints[f.name] > f.value
    if isinstance(f, LessThanInt):
        return f.name in ints and ints[f.name] < f.value
    if isinstance(f, And):
        return all(evaluate(p, text, floats, ints) for p in f.parts)
    if isinstance(f, Or):
        return any(evaluate(p, text, floats, ints) for p in f.parts)
    return not evaluate(f.part, text, floats, ints)
