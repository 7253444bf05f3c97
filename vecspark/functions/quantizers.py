"""Vector quantizers: FP16, INT8 (per-dimension ranges), product and binary codes.

INT8 and binary codes are built from higher-order functions and stay in the JVM; FP16 and product codes are numpy
kernels over Arrow batches. Training is one aggregation over all rows (INT8) or k-means (product).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.session import arrow_udf

#: A range smaller than this counts as 1, so that constant dimensions encode to 0.
TINY = 1e-9


class Quantizer:
    """encode, decode: Columns from array<float> to the code and back; encoded_size: bytes of a code."""

    def __init__(self, dimension: int):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.dimension = dimension

    def encoded_size(self) -> int:
        raise NotImplementedError

    def compression_ratio(self) -> float:
        return 4.0 * self.dimension / self.encoded_size()

    def encode(self, vector: Column) -> Column:
        raise NotImplementedError

    def decode(self, code: Column) -> Column:
        raise NotImplementedError


class Fp16(Quantizer):
    """IEEE half floats, little-endian; rounded to nearest even, subnormals kept."""

    def encoded_size(self) -> int:
        return 2 * self.dimension

    def encode(self, vector: Column) -> Column:
        @arrow_udf("binary")
        def run(v: pd.Series) -> pd.Series:
            with np.errstate(over="ignore"):
                half = np.concatenate([np.zeros(0, "<f4"), *v.dropna()]).astype("<f4").astype("<f2").tobytes()
            ends = (2 * v.map(lambda x: 0 if x is None else len(x))).cumsum().tolist()
            return pd.Series([None if x is None else half[a:b] for x, a, b in zip(v, [0, *ends[:-1]], ends, strict=True)], dtype=object)

        return run(vector)

    def decode(self, code: Column) -> Column:
        @arrow_udf("array<float>")
        def run(c: pd.Series) -> pd.Series:
            return c.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype("<f4"))

        return run(code)


@dataclass(frozen=True)
class Ranges:
    low: Sequence[float]
    high: Sequence[float]


class Int8(Quantizer):
    """One byte a component (0 to 255, as array<int>), scaled to the dimension's range over the training rows."""

    def __init__(self, dimension: int, ranges: Ranges | None = None):
        super().__init__(dimension)
        self.ranges = ranges

    def encoded_size(self) -> int:
        return self.dimension

    @staticmethod
    def limits(points: DataFrame, vector: str = "vector") -> DataFrame:
        """dim (from 0), low and high of each dimension."""
        exploded = points.select(F.posexplode(vector).alias("dim", "x"))
        return exploded.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))

    def train(self, points: DataFrame, vector: str = "vector") -> Int8:
        rows = sorted(self.limits(points, vector).collect())  # one row a dimension
        if len(rows) != self.dimension:
            raise ValueError(f"training needs vectors of {self.dimension} components")
        self.ranges = Ranges([r["low"] for r in rows], [r["high"] for r in rows])
        return self

    def _spans(self) -> tuple[Column, Column, np.ndarray]:
        if self.ranges is None:
            raise ValueError("the quantizer isn't trained")
        low, high = np.array(self.ranges.low, float), np.array(self.ranges.high, float)
        span = np.where(high - low < TINY, 1.0, high - low)
        return F.array(*[F.lit(float(x)) for x in low]), F.array(*[F.lit(float(x)) for x in span]), span

    def encode(self, vector: Column) -> Column:
        low, span, _ = self._spans()
        share = F.zip_with(F.zip_with(vector, low, lambda x, a: x.cast("double") - a), span, lambda x, s: x / s)
        return F.transform(share, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 255 + 0.5).cast("int"))))

    def decode(self, code: Column) -> Column:
        low, span, _ = self._spans()
        return F.zip_with(F.zip_with(code, span, lambda q, s: q / F.lit(255.0) * s), low, lambda x, a: x + a)

    def distance(self, a: Column, b: Column) -> Column:
        """The L2 distance of two codes, scaled by the mean range."""
        _, _, span = self._spans()
        square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda t, x: t + x)
        return F.sqrt(square.cast("double")) * float(span.mean()) / 255.0


class Binary(Quantizer):
    """One bit a component, 1 from 0 on; eight to a byte, the first component lowest (array<int> of bytes)."""

    def encoded_size(self) -> int:
        return (self.dimension + 7) // 8

    def encode(self, vector: Column) -> Column:
        def byte(i: Column) -> Column:
            bits = F.slice(vector, i * 8 + 1, 8)
            return F.aggregate(F.transform(bits, lambda x, k: F.when(x >= 0, F.pow(F.lit(2), k).cast("int")).otherwise(0)), F.lit(0), lambda t, x: t + x)

        return F.transform(F.sequence(F.lit(0), F.lit(self.encoded_size() - 1)), byte)

    def decode(self, code: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: F.when(F.element_at(code, F.floor(i / 8).cast("int") + 1).bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) != 0, F.lit(1.0)).otherwise(F.lit(-1.0)).cast("float"))

    @staticmethod
    def hamming(a: Column, b: Column) -> Column:
        """Bits that differ, over the shorter of two codes."""
        n = F.least(F.size(a), F.size(b))
        return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


class Product(Quantizer):
    """The nearest of k centroids in each of m equal parts, one byte each. The codebook is m * k * (dim / m) numbers."""

    def __init__(self, dimension: int, m: int = 8, k: int = 256, codebook: np.ndarray | None = None):
        super().__init__(dimension)
        if dimension % m or not 0 < k <= 256:
            raise ValueError("the dimension must be a multiple of m, and k from 1 to 256")
        self.m, self.k, self.codebook = m, k, codebook

    def encoded_size(self) -> int:
        return self.m

    def train(self, points: DataFrame, vector: str = "vector", max_iter: int = 20, seed: int = 42) -> Product:
        from vecspark.operators.ivf import kmeans

        width = self.dimension // self.m
        parts = [kmeans(points.select(F.slice(vector, s * width + 1, width).alias("vector")), self.k, max_iter, seed=seed) for s in range(self.m)]
        size = min(len(p) for p in parts)
        self.codebook = np.stack([p[:size] for p in parts])
        return self

    def _book(self) -> np.ndarray:
        if self.codebook is None:
            raise ValueError("the quantizer isn't trained")
        return self.codebook

    def encode(self, vector: Column) -> Column:
        book = self._book()

        @arrow_udf("binary")
        def run(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()).astype(float).reshape(len(v), book.shape[0], -1) if len(v) else np.zeros((0, *book.shape[::2]))
            near = np.stack([((x[:, s, None] - book[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(len(book))], axis=1)
            return pd.Series([r.tobytes() for r in near.astype(np.uint8)])

        return run(vector)

    def decode(self, code: Column) -> Column:
        book = self._book()

        @arrow_udf("array<float>")
        def run(c: pd.Series) -> pd.Series:
            return c.map(lambda x: np.concatenate([book[s][i] for s, i in enumerate(x)]).astype(np.float32))

        return run(code)

    def distance(self, query: Sequence[float], code: Column) -> Column:
        """The L2 distance of a query to what a code stands for, from one table of part distances."""
        book = self._book()
        square = ((np.asarray(query, float).reshape(len(book), 1, -1) - book) ** 2).sum(axis=2)

        @arrow_udf("double")
        def run(c: pd.Series) -> pd.Series:
            codes = np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1)
            return pd.Series(np.sqrt(square[np.arange(len(book))[None], codes].sum(axis=1)))

        return run(code)


def create(name: str, dimension: int) -> Quantizer | None:
    """A quantizer by name: NONE (no quantizer), FP16, INT8, PQ (8 parts where they divide, 256 centroids), BINARY."""
    if name == "NONE":
        return None
    if name == "PQ":
        return Product(dimension, next((m for m in (8, 4, 16, 2, 1) if dimension % m == 0), 1))
    found = {"FP16": Fp16, "INT8": Int8, "BINARY": Binary}.get(name)
    if found is None:
        raise ValueError(f"unknown quantizer {name}")
    return found(dimension)
