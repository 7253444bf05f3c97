"""Distances between vectors: smaller is nearer, for every metric. Vectors of different lengths are an error.

Column builders work on array columns and stay in the JVM; kernels work on whole matrices of a batch with numpy. A
distance can also be registered as a Python kernel under a name of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.session import arrow_udf

METRICS = ("L2", "IP", "COSINE", "HAMMING")
#: Pairs whose words are compared at once; factor of the rounding errors of a sum of products.
TILE, ROUNDING = 1 << 15, 4 * np.finfo(float).eps


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def same_size(a: Column, b: Column, distance: Column) -> Column:
    return F.when(F.size(a) == F.size(b), distance).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def l2(a: Column, b: Column) -> Column:
    return same_size(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def inner_product(a: Column, b: Column) -> Column:
    return same_size(a, b, -dot(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, from 0 to 2; 2 if either vector has no length."""
    na, nb = dot(a, a), dot(b, b)
    share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(na * nb)))
    return same_size(a, b, F.when((na <= 0) | (nb <= 0), F.lit(2.0)).otherwise(1.0 - share))


def hamming(a: Column, b: Column) -> Column:
    """The bits in which the 32-bit floats differ. Spark has no access to a float's bits, so this is an Arrow kernel."""

    @arrow_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        flat = [np.concatenate([np.zeros(0, "<f4"), *v]).astype("<f4").view("u4") for v in (a, b)]  # pairs of one size: others fail before
        n = a.map(len).to_numpy(np.int64)
        total = np.concatenate([[0], np.cumsum(np.bitwise_count(flat[0] ^ flat[1]), dtype=np.int64)])
        ends = np.cumsum(n)
        return pd.Series((total[ends] - total[ends - n]).astype(float))

    fit = F.size(a) == F.size(b)
    none = F.array().cast("array<float>")
    return same_size(a, b, apart(F.when(fit, a).otherwise(none), F.when(fit, b).otherwise(none)))


COLUMNS: dict[str, Callable[[Column, Column], Column]] = {"L2": l2, "IP": inner_product, "COSINE": cosine, "HAMMING": hamming}


def _cosine_kernel(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    nq, nx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    length = np.sqrt(nq[:, None] * nx[None])
    share = np.divide(q @ x.T, length, out=np.zeros(length.shape), where=length > 0)
    return np.where(length > 0, 1 - share.clip(-1, 1), 2.0)


def _l2_kernel(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    square = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (q @ x.T)
    return np.sqrt(np.maximum(square, 0))


def _words(v: np.ndarray) -> np.ndarray:
    """The rows' 32-bit floats, two in each 64-bit word."""
    v = v.astype("<f4")
    return np.ascontiguousarray(np.pad(v, ((0, 0), (0, v.shape[1] % 2)))).view("u8")


def _hamming_kernel(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)), np.int32)
    q, x = _words(q), np.ascontiguousarray(_words(x).T)
    step = max(1, TILE // max(1, x.shape[1]))
    for a in range(0, len(q), step):  # a few queries at once, so that what is counted stays in the cache
        some = out[a : a + step]
        for j, column in enumerate(x):
            some += np.bitwise_count(column ^ q[a : a + step, j, None])
    return out.astype(float)


#: Matrices of distances between the rows of q and x (doubles).
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"L2": _l2_kernel, "IP": lambda q, x: -(q @ x.T), "COSINE": _cosine_kernel, "HAMMING": _hamming_kernel}


def _size(s: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(s), np.abs(s), 0)


def ordered(metric: str, q: np.ndarray, x: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """A matrix that grows with the distances of the rows of q and x, and a function of one distance for each q.

    It gives the matrix's value up to which all pairs lie whose distance, as ``paired`` has it, is at most that one: with
    room for the rounding of either. The matrix needs few passes and holds no NaN; rows too large or too small for it get
    the least value there is.
    """
    if metric not in METRICS or metric == "HAMMING":
        far = (kernel or KERNELS[metric])(q, x)
        return np.where(np.isnan(far), np.inf, far), lambda s: s + (0 if metric == "HAMMING" else _size(s) * 1e-9 + 1e-6)
    room = ROUNDING * (x.shape[1] + 4)
    with np.errstate(all="ignore"):
        qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
        odd_q, odd_x = (~((v == 0) | ((v > 1e-140) & (v < 1e140))) for v in (qq, xx))
        most = np.sqrt(xx.max(initial=0, where=~odd_x))
        length = np.sqrt(qq)
        if metric == "L2":
            far = (-2 * q) @ x.T
            far += xx
        elif metric == "IP":
            far = -q @ x.T
        else:
            far = (-q / np.where(qq > 0, length, 1)[:, None]) @ (x / np.sqrt(np.where(xx > 0, xx, 1))[:, None]).T
            far[qq == 0], far[:, xx == 0] = 1, 1
    if odd_q.any() or odd_x.any():
        far[odd_q], far[:, odd_x] = -np.inf, -np.inf
        qq, length = np.where(odd_q, 0, qq), np.where(odd_q, 0, length)
    if metric == "L2":
        return far, lambda s: s * s - qq + room * (s * s + (length + most) ** 2)
    return far, (lambda s: s + room * (length * most + _size(s))) if metric == "IP" else (lambda s: s - 1 + 4 * room)


def paired(metric: str, q: np.ndarray, x: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Exact distances of row i of q to row i of x, without the cancellation that a matrix product can bring."""
    if metric == "L2":
        return np.sqrt(((q - x) ** 2).sum(axis=1))
    if metric in METRICS:
        if metric == "HAMMING":
            return np.bitwise_count(q.astype("<f4").view("u4") ^ x.astype("<f4").view("u4")).sum(axis=1).astype(float)
        total = (q * x).sum(axis=1)
        if metric == "IP":
            return -total
        length = np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1))
        return np.where(length > 0, 1 - np.divide(total, length, out=np.zeros_like(total), where=length > 0).clip(-1, 1), 2.0)
    return np.array([(kernel or KERNELS[metric])(q[i : i + 1], x[i : i + 1])[0, 0] for i in range(len(q))])


def register(name: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """A distance of one's own: a function of two matrices that returns the matrix of distances of their rows."""
    KERNELS[name] = kernel

    @arrow_udf("double")
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(kernel(np.asarray(x, float)[None], np.asarray(y, float)[None])[0, 0]) for x, y in zip(a, b, strict=True)])

    COLUMNS[name] = lambda a, b: same_size(a, b, pairs(a, b))


def between(metric: str, a: Column, b: Column | Sequence[float]) -> Column:
    """The distance of a vector column to another or to one vector, as a double."""
    if metric not in COLUMNS:
        raise ValueError(f"unknown metric {metric}; known are {', '.join(COLUMNS)}")
    return COLUMNS[metric](a, b if isinstance(b, Column) else F.array(*[F.lit(float(np.float32(x))) for x in b]).cast("array<float>"))
