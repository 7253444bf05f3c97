"""Bloom filters over ids, and routing of ids to shards.

A filter is one small row of bytes, built by an aggregation that ORs the bits of each task; nothing but the bits moves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.session import arrow_udf, ship


class Bloom:
    """n expected ids at a share p of false positives; no false negatives. Bit places come from two 64-bit hashes."""

    def __init__(self, n: int, p: float = 0.01, bits: bytes | None = None):
        if n <= 0 or not 0 < p < 1:
            raise ValueError("n must be positive and p between 0 and 1")
        self.size = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / n * math.log(2)))
        self.bits = np.frombuffer(bits, np.uint8).copy() if bits else np.zeros((self.size + 7) // 8, np.uint8)

    def places(self, ids) -> np.ndarray:
        table = pd.Series(list(ids), dtype=object)
        a = pd.util.hash_array(table.to_numpy(), hash_key="vecsparkvecspark", categorize=False)
        b = pd.util.hash_array(table.to_numpy(), hash_key="sparkvecsparkvec", categorize=False) | np.uint64(1)
        return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64)[None] * b[:, None]) % np.uint64(self.size)).astype(np.int64)

    def add(self, *ids: str) -> None:
        at = self.places(ids).reshape(-1)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def might_contain(self, *ids: str) -> np.ndarray:
        at = self.places(ids)
        return (self.bits[at >> 3] >> (at & 7) & 1).all(axis=1)

    def fill_ratio(self) -> float:
        return float(np.bitwise_count(self.bits).sum() / self.size)

    def matches(self, column: Column) -> Column:
        """Whether each id may be contained."""

        @arrow_udf("boolean")
        def run(ids: pd.Series) -> pd.Series:
            return pd.Series(self.might_contain(*ids) if len(ids) else [], dtype=bool)

        return run(column.cast("string"))


def bloom_of(points: DataFrame, id_col: str = "id", n: int | None = None, p: float = 0.01) -> Bloom:
    """The filter of all ids (for twice as many as there are, unless n says otherwise)."""
    ship(points.sparkSession)
    n = n or max(1, 2 * points.count())

    def build(batches):
        own = Bloom(n, p)
        for b in batches:
            if len(b):
                own.add(*b.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"bits": pa.array([own.bits.tobytes()], pa.binary())})

    out = Bloom(n, p)
    for row in points.select(points[id_col].cast("string")).mapInArrow(build, "bits binary").toLocalIterator():
        out.bits |= np.frombuffer(row[0], np.uint8)
    return out


class BloomRegistry:
    """A filter for each collection; an unknown collection may contain anything."""

    def __init__(self, expected: int = 10_000, p: float = 0.01):
        self.expected, self.p = expected, p
        self.filters: dict[str, Bloom] = {}

    def mark(self, collection: str, id: str) -> None:
        self.filters.setdefault(collection, Bloom(self.expected, self.p)).add(id)

    def might_contain(self, collection: str, id: str) -> bool:
        return collection not in self.filters or bool(self.filters[collection].might_contain(id)[0])

    def rebuild(self, collection: str, points: DataFrame, id_col: str = "id") -> None:
        self.filters[collection] = bloom_of(points, id_col, max(2 * points.count(), self.expected), self.p)


def string_hash(text: str) -> int:
    """The 32-bit polynomial hash of a string's UTF-16 units, base 31, as a signed number."""
    h = 0
    units = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (31 * h + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def shard(id_column: Column, shards: int) -> Column:
    """The shard of each id, from 0 on: |string hash| modulo the number of shards."""

    @arrow_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: abs(string_hash(x)) % shards)

    return run(id_column.cast("string"))
