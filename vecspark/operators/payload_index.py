"""Sets of ids by payload value. Columnar statistics do the work of an inverted index: each is a pruned, filtered scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.plans import filters
from vecspark.plans.filters import Filter, matching


class PayloadIndex:
    """Answers in DataFrames of one id column."""

    def __init__(self, points: DataFrame, id_col: str = "id", fields: dict[str, type] | None = None):
        self.points, self.id_col = points, id_col
        self.fields = dict(fields or {})

    def _ids(self, f: Filter) -> DataFrame:
        return matching(self.points, f).select(self.id_col)

    def eq(self, field: str, value) -> DataFrame:
        return self._ids(filters.eq(field, value))

    def ne(self, field: str, value, universe: DataFrame) -> DataFrame:
        return universe.select(self.id_col).join(self.eq(field, value), self.id_col, "left_anti")

    def in_values(self, field: str, values) -> DataFrame:
        return self._ids(filters.in_values(field, values))

    def range(self, field: str, low: float | None = None, high: float | None = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        parts = [] if low is None else [(filters.gte if low_inclusive else filters.gt)(field, low)]
        parts += [] if high is None else [(filters.lte if high_inclusive else filters.lt)(field, high)]
        return self._ids(filters.all_of(filters.exists(field), *parts))

    def exists(self, field: str) -> DataFrame:
        return self._ids(filters.exists(field))

    def union(self, *sets: DataFrame) -> DataFrame:
        out = sets[0]
        for s in sets[1:]:
            out = out.unionByName(s)
        return out.distinct()

    def intersect(self, *sets: DataFrame) -> DataFrame:
        out = sets[0]
        for s in sets[1:]:
            out = out.join(s, self.id_col, "left_semi")
        return out.distinct()

    def difference(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, self.id_col, "left_anti").distinct()

    def resolve(self, where: Filter) -> DataFrame | None:
        """The ids of a filter of eq, in, exists and AND; None for what such an index doesn't answer."""
        leaves = where.parts if where.op == "and" else (where,)
        if not leaves or any(p.op not in ("eq", "in", "exists") for p in leaves):
            return None
        return self._ids(where)

    def index_field(self, field: str, of: type) -> None:
        self.fields[field] = of

    def is_indexed(self, field: str) -> bool:
        return field in self.fields

    def indexed_fields(self) -> set[str]:
        return set(self.fields)

    def clear(self) -> None:
        self.fields.clear()
        self.points = self.points.limit(0)

    def size(self) -> int:
        """The number of distinct (field, value) pairs of the indexed fields."""
        if not self.fields:
            return 0
        row = self.points.agg(*[F.count_distinct(f).alias(f) for f in self.fields]).first()
        return sum(row)
