"""Metadata filters: a conjunction of equalities and numeric ranges.

Metadata is ``map<string,string>``.  A filter comes as JSON-like Python: null or
{} (no filter), {"key": "value", ...} (equalities), or {"must": [...]} with
{"op": "eq", "field", "value"} and {"op": "range", "field", "gt", "gte", "lt",
"lte"}.  Any other shape is an error.  A range holds where the field parses as a
number and meets all bounds; without bounds, where it parses as a number.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that count as numbers: no blanks, no suffixes, no hexadecimal digits.
NUMBER = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"
BOUNDS = ("gt", "gte", "lt", "lte")


class FilterError(ValueError):
    """A filter of an unknown shape."""


@dataclass(frozen=True)
class Equals:
    field: str
    value: str

    def column(self, metadata: Column) -> Column:
        return F.coalesce(metadata[self.field] == self.value, F.lit(False))

    def matches(self, metadata: dict[str, str]) -> bool:
        return metadata.get(self.field) == self.value


@dataclass(frozen=True)
class InRange:
    field: str
    bounds: tuple[tuple[str, float], ...] = ()

    def column(self, metadata: Column) -> Column:
        text = metadata[self.field]
        if not self.bounds:
            return F.coalesce(text.rlike(NUMBER), F.lit(False))
        n = F.when(text.rlike(NUMBER), text.try_cast("double"))
        tests = {"gt": lambda b: n > b, "gte": lambda b: n >= b, "lt": lambda b: n < b, "lte": lambda b: n <= b}
        return F.coalesce(reduce(Column.__and__, [tests[k](b) for k, b in self.bounds], n.isNotNull() & ~F.isnan(n)), F.lit(False))


@dataclass(frozen=True)
class Filter:
    """All predicates must hold; without any, every row matches."""

    predicates: tuple[Equals | InRange, ...] = field(default=())

    @property
    def is_empty(self) -> bool:
        return not self.predicates

    @property
    def exact_terms(self) -> list[tuple[str, str]]:
        return [(p.field, p.value) for p in self.predicates if isinstance(p, Equals)]

    @property
    def range_predicates(self) -> list[InRange]:
        return [p for p in self.predicates if isinstance(p, InRange)]

    def column(self, metadata: Column | str = "metadata") -> Column:
        metadata = F.col(metadata) if isinstance(metadata, str) else metadata
        return reduce(Column.__and__, [p.column(metadata) for p in self.predicates], F.lit(True))

    def apply(self, df: DataFrame, metadata: str = "metadata") -> DataFrame:
        """The rows that match; the same DataFrame if the filter is empty."""
        return df if self.is_empty else df.filter(self.column(metadata))


def parse(spec: object) -> Filter:
    """A filter from its JSON form."""
    if isinstance(spec, Filter):
        return spec
    if spec is None or spec == {}:
        return Filter()
    if not isinstance(spec, dict):
        raise FilterError(f"a filter is an object or null, not {type(spec).__name__}")
    if set(spec) == {"must"} and isinstance(spec["must"], list):
        return Filter(tuple(_predicate(p) for p in spec["must"]))
    if all(isinstance(k, str) and isinstance(v, str) for k, v in spec.items()):
        return Filter(tuple(Equals(k, v) for k, v in spec.items()))
    raise FilterError(f"unknown filter: {spec!r}")


def _predicate(p: object) -> Equals | InRange:
    if not isinstance(p, dict) or not isinstance(p.get("field"), str):
        raise FilterError(f"unknown predicate: {p!r}")
    if p.get("op") == "eq" and isinstance(p.get("value"), str) and set(p) <= {"op", "field", "value"}:
        return Equals(p["field"], p["value"])
    if p.get("op") == "range" and set(p) <= {"op", "field", *BOUNDS}:
        bounds = [(k, p[k]) for k in BOUNDS if p.get(k) is not None]
        if all(isinstance(b, (int, float)) and not isinstance(b, bool) for _, b in bounds):
            return InRange(p["field"], tuple((k, float(b)) for k, b in bounds))
    raise FilterError(f"unknown predicate: {p!r}")


def inverted_index(df: DataFrame, key: str = "doc_id", metadata: str = "metadata") -> DataFrame:
    """Per metadata key and value: n, the number of rows that hold it."""
    return df.select(key, F.explode(metadata).alias("key", "value")).groupBy("key", "value").agg(F.count_distinct(key).alias("n"))
