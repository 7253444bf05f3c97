"""Payload filters: an expression tree, its JSON form, and its compilation to one boolean Column.

Predicates are two-valued: a missing field is null, and null never makes a result unknown. ``ne`` and ``nin`` therefore
hold for a missing field. Values compare only within a kind (numbers as doubles, strings, booleans); a comparison
across kinds is false. Under a top-level AND a leaf is compiled to the plain comparison, which drops null rows just as
well and is pushed down to Parquet; below OR and NOT to the form that is never null.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
LEAVES = ("eq", "ne", *ORDERED, "in", "nin", "exists", "contains")


def kind(value: Any) -> str:
    """null, boolean, number, string, array or object."""
    for name, types in (("null", type(None)), ("boolean", bool), ("number", (int, float)), ("string", str), ("array", (list, tuple, set, frozenset)), ("object", dict)):
        if isinstance(value, types):
            return name
    return "number" if hasattr(value, "__float__") else type(value).__name__


def same(a: Any, b: Any) -> bool:
    if kind(a) == kind(b) == "number":
        return float(a) == float(b) or (math.isnan(a) and math.isnan(b))
    return kind(a) == kind(b) and a == b


@dataclass(frozen=True)
class Filter:
    """op is a leaf of LEAVES with field and value, or and, or, not with parts."""

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    def evaluate(self, payload: dict[str, Any] | None) -> bool:
        if self.op in ("and", "or"):
            return (all if self.op == "and" else any)(p.evaluate(payload) for p in self.parts)
        if self.op == "not":
            return not self.parts[0].evaluate(payload)
        v = (payload or {}).get(self.field)
        if self.op in ("eq", "ne"):
            return same(v, self.value) == (self.op == "eq")
        if self.op in ("in", "nin"):
            return any(same(v, x) for x in self.value) == (self.op == "in")
        if self.op == "exists":
            return v is not None
        if self.op == "contains":
            return isinstance(v, str) and self.value in v
        if kind(v) != kind(self.value) or kind(v) not in ("number", "string"):
            return False
        return ORDERED[self.op](_rank(v), _rank(self.value))

    def equalities(self) -> dict[str, Any] | None:
        """{field: value} if the filter is one equality or an AND of equalities on different fields, else None."""
        leaves = self.parts if self.op == "and" else (self,)
        if not leaves or any(p.op != "eq" for p in leaves) or len({p.field for p in leaves}) < len(leaves):
            return None
        return {p.field: p.value for p in leaves}

    def to_dict(self) -> dict[str, Any]:
        """The JSON form; parse_filter() reads it back."""
        if self.op in ("and", "or"):
            return {self.op: [p.to_dict() for p in self.parts]}
        if self.op == "not":
            return {"not": self.parts[0].to_dict()}
        return {self.field: {self.op: list(self.value) if self.op in ("in", "nin") else self.value}}

    def __str__(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, default=str)

    def fields(self) -> set[str]:
        return {self.field} if self.field is not None else set().union(*(p.fields() for p in self.parts)) if self.parts else set()


def _rank(v: Any) -> Any:
    """Orders doubles with NaN last; strings as they are."""
    return v if isinstance(v, str) else (math.isnan(v), 0.0 if math.isnan(v) else float(v))


def eq(field: str, value: Any) -> Filter:
    return Filter("eq", field, value)


def ne(field: str, value: Any) -> Filter:
    return Filter("ne", field, value)


def gt(field: str, value: Any) -> Filter:
    return Filter("gt", field, value)


def gte(field: str, value: Any) -> Filter:
    return Filter("gte", field, value)


def lt(field: str, value: Any) -> Filter:
    return Filter("lt", field, value)


def lte(field: str, value: Any) -> Filter:
    return Filter("lte", field, value)


def in_values(field: str, values) -> Filter:
    return Filter("in", field, tuple(values))


def not_in(field: str, values) -> Filter:
    return Filter("nin", field, tuple(values))


def exists(field: str) -> Filter:
    return Filter("exists", field)


def contains(field: str, part: str) -> Filter:
    return Filter("contains", field, part)


def all_of(*parts: Filter) -> Filter:
    """AND; of nothing: true."""
    return Filter("and", parts=tuple(parts))


def any_of(*parts: Filter) -> Filter:
    """OR; of nothing: false."""
    return Filter("or", parts=tuple(parts))


#: JSON combinators: how their list of parts becomes a filter.
COMBINATORS = {
    "and": lambda parts: all_of(*parts),
    "must": lambda parts: all_of(*parts),
    "or": lambda parts: any_of(*parts),
    "should": lambda parts: any_of(*parts),
    "must_not": lambda parts: all_of(*(~p for p in parts)),
}
#: The kind of value that an operator asks for, where it does.
ASKS = {"contains": "string", "in": "array", "nin": "array", **dict.fromkeys(ORDERED, "number")}


def parse_filter(spec: Any, where: str = "filter") -> Filter | None:
    """A filter from its JSON form; None if it puts no constraint. ValueError names the place of what is wrong."""
    if spec is None:
        return None
    _ask(spec, "object", where)
    found = [p for key, value in spec.items() if (p := _entry(str(key), value, f"{where}.{key}")) is not None]
    return _joined(found)


def _joined(parts: list[Filter]) -> Filter | None:
    return None if not parts else parts[0] if len(parts) == 1 else all_of(*parts)


def _ask(value: Any, wanted: str, where: str) -> None:
    if kind(value) != wanted:
        raise ValueError(f"{where} must be of JSON type {wanted}, not {kind(value)}")


def _entry(key: str, value: Any, where: str) -> Filter | None:
    if key == "not":
        _ask(value, "object", where)
        inner = parse_filter(value, where)
        return None if inner is None else ~inner
    if key in COMBINATORS:
        _ask(value, "array", where)
        parts = [p for i, x in enumerate(value) if (p := parse_filter(x, f"{where}[{i}]")) is not None]
        return COMBINATORS[key](parts) if parts else None
    if not isinstance(value, dict):
        return eq(key, value)
    if not value:
        raise ValueError(f"{where} has no operator")
    return _joined([_leaf(key, op, x, f"{where}.{op}") for op, x in value.items()])


def _leaf(field: str, op: str, value: Any, where: str) -> Filter:
    if op not in LEAVES:
        raise ValueError(f"{where}: unknown operator; known are {', '.join(LEAVES)}")
    if op in ASKS:
        _ask(value, ASKS[op], where)
    if op == "exists":
        return ~exists(field) if value is False else exists(field)
    return Filter(op, field, tuple(value) if op in ("in", "nin") else value)


class TypedPayload:
    """Payload fields that are columns of their own (of a DataFrame, or of one of its struct columns)."""

    def __init__(self, df: DataFrame, struct: str | None = None):
        schema = df.schema[struct].dataType if struct else df.schema
        self.columns = {f.name: (df[struct][f.name] if struct else df[f.name], f.dataType) for f in schema.fields}

    def leaf(self, f: Filter) -> Column:
        """The leaf's condition, null or false where it doesn't hold (ne and nin: never null)."""
        if f.field not in self.columns:
            return F.lit(f.evaluate({}))
        c, of = self.columns[f.field]
        if f.op == "exists":
            return c.isNotNull()
        if f.op == "contains":
            return c.contains(f.value) if isinstance(of, T.StringType) else F.lit(False)
        if f.op in ("eq", "ne"):
            found = self._equal(c, of, f.value)
            return found if f.op == "eq" else ~found
        if f.op in ("in", "nin"):
            found = functools.reduce(operator.or_, self._members(c, of, f.value), F.lit(False))
            return found if f.op == "in" else ~F.coalesce(found, F.lit(False))
        if kind(f.value) not in ("number", "string") or kind(f.value) != self._kind(of):
            return F.lit(False)
        return ORDERED[f.op](*self._sides(c, of, f.value))

    @staticmethod
    def _kind(of: T.DataType) -> str:
        return "number" if isinstance(of, T.NumericType) else "string" if isinstance(of, T.StringType) else "boolean" if isinstance(of, T.BooleanType) else "other"

    @staticmethod
    def _sides(c: Column, of: T.DataType, value: Any) -> tuple[Column, Column]:
        """Both sides of a comparison, as doubles unless they are whole numbers or strings."""
        if isinstance(value, str) or (isinstance(of, T.IntegralType) and isinstance(value, int) and -(2**31) <= value < 2**31):
            return c, F.lit(value)
        return c.cast("double"), F.lit(float(value))

    def _equal(self, c: Column, of: T.DataType, value: Any) -> Column:
        if value is None:
            return c.isNull()
        if kind(value) != self._kind(of):
            if kind(value) == "array" and isinstance(of, T.ArrayType):
                return F.to_json(c).eqNullSafe(json.dumps(list(value), separators=(",", ":")))
            return F.lit(False)
        if kind(value) == "number":
            a, b = self._sides(c, of, value)
            return a.eqNullSafe(b)
        return c.eqNullSafe(F.lit(value))

    def _members(self, c: Column, of: T.DataType, values) -> list[Column]:
        own = [v for v in values if kind(v) == self._kind(of)]
        out = [c.isNull()] if any(v is None for v in values) else []
        if own:
            pairs = [self._sides(c, of, v) if kind(v) == "number" else (c, F.lit(v)) for v in own]
            out.append(pairs[0][0].isin(*[b for _, b in pairs]) if len({str(a) for a, _ in pairs}) == 1 else functools.reduce(operator.or_, [a == b for a, b in pairs]))
        return out


class VariantPayload:
    """Payload fields inside a VARIANT column (for payloads without a fixed schema)."""

    NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "INT", "SMALLINT", "TINYINT")

    def __init__(self, column: Column):
        self.column = column

    def leaf(self, f: Filter) -> Column:
        path = "$[" + json.dumps(f.field, ensure_ascii=False) + "]"
        found = F.try_variant_get(self.column, path, "variant")
        type_name = F.schema_of_variant(found)
        number = functools.reduce(operator.or_, [type_name.startswith(n) for n in self.NUMBERS])
        present = found.isNotNull() & (type_name != "VOID")
        as_number = F.when(number, F.try_variant_get(self.column, path, "double"))
        as_string = F.when(type_name == "STRING", F.try_variant_get(self.column, path, "string"))
        as_boolean = F.when(type_name == "BOOLEAN", F.try_variant_get(self.column, path, "boolean"))
        as_json = F.when(present, F.to_json(found))

        def equal(value: Any) -> Column:
            if value is None:
                return ~F.coalesce(present, F.lit(False))
            if kind(value) == "number":
                return as_number.eqNullSafe(F.lit(float(value)))
            if kind(value) == "string":
                return as_string.eqNullSafe(F.lit(value))
            if kind(value) == "boolean":
                return as_boolean.eqNullSafe(F.lit(value))
            return as_json.eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))))

        if f.op == "exists":
            return F.coalesce(present, F.lit(False))
        if f.op == "contains":
            return as_string.contains(f.value)
        if f.op in ("eq", "ne"):
            return equal(f.value) if f.op == "eq" else ~equal(f.value)
        if f.op in ("in", "nin"):
            any_equal = functools.reduce(operator.or_, [equal(v) for v in f.value], F.lit(False))
            return any_equal if f.op == "in" else ~any_equal
        side = {"number": as_number, "string": as_string}.get(kind(f.value))
        return F.lit(False) if side is None else ORDERED[f.op](side, F.lit(f.value if isinstance(f.value, str) else float(f.value)))


def compiled(f: Filter | None, payload: TypedPayload | VariantPayload, top: bool = True) -> Column:
    """The filter as one Column. With top, rows to drop may get null; else it is true or false everywhere."""
    if f is None:
        return F.lit(True)
    if f.op == "and":
        return functools.reduce(operator.and_, [compiled(p, payload, top) for p in f.parts], F.lit(True)) if len(f.parts) != 1 else compiled(f.parts[0], payload, top)
    if f.op == "or":
        return functools.reduce(operator.or_, [compiled(p, payload, False) for p in f.parts], F.lit(False))
    if f.op == "not":
        return ~compiled(f.parts[0], payload, False)
    leaf = payload.leaf(f)
    return leaf if top else F.coalesce(leaf, F.lit(False))


def matching(df: DataFrame, f: Filter | None, payload: str | None = None) -> DataFrame:
    """The rows that a filter accepts. payload: a struct, VARIANT or JSON string column; none: df's own columns."""
    if f is None:
        return df
    of = df.schema[payload].dataType if payload else None
    if isinstance(of, T.VariantType):
        return df.filter(compiled(f, VariantPayload(df[payload])))
    if isinstance(of, T.StringType):
        return df.filter(compiled(f, VariantPayload(F.try_parse_json(df[payload]))))
    return df.filter(compiled(f, TypedPayload(df, payload)))
