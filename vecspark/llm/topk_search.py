"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into equal segments, coarse and fine. From a segment's means and the lengths of what deviates from them
follows a bound: the squared distance of two vectors is at least the sum over segments of size * (difference of
means)^2 + (difference of deviation lengths)^2, so their inner product is at most the sum of size * mean * mean +
deviation * deviation. Pairs are bounded coarse, then fine, against the query's k-th best so far; what survives is
computed exactly, in integers.

Queries go out in chunks of bounded size; candidates stay where they are and are read once for each chunk, and each
task returns at most k rows for each query. A query starts with the k-th best among its own chunk, which is a true
lower bound, so tasks return little more than the answer.

Components are floor(scale * x). Vectors that are null, empty or hold null or non-finite components take no part, nor
do rows with a null id; vectors of different lengths aren't compared. A row isn't its own neighbour, a repeated row is.
Components and scores beyond 64 bits count as the nearest 64-bit number. Queries and candidates meet in blocks of
bounded size, so a task's memory doesn't depend on how many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import textscan
from vecspark.session import ship, write_table

K, SCALE = 5, 256
#: Segments, coarse to fine; queries of a chunk; queries and candidates that meet at once; queries used for the first bounds.
LEVELS, CHUNK, BLOCK, SEEDS = (4, 16), 8192, 1024, 2048
#: Pairs whose exact scores are computed at once; the least and the largest score.
PAIRS, LEAST, MOST = 1 << 14, -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """row, vec_id and the integer components (8 bytes each) of all vectors that take part."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False)
            n = np.diff(np.append(lists.offsets.to_numpy()[: len(lists)], lists.offsets.to_numpy()[len(lists)]))
            ends = np.cumsum(n)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (bad[ends] == bad[ends - n]) & (n > 0)
            with np.errstate(over="ignore"):
                whole = np.floor(np.where(np.isfinite(x), x, 0) * scale)
            raw = np.where(whole >= 2.0**63, MOST, np.clip(whole, -(2.0**63), 2.0**63 - 1024).astype("<i8")).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[(e - m) * 8 : e * 8] if g else None for e, m, g in zip(ends.tolist(), n.tolist(), good.tolist(), strict=True)], pa.binary())], ["row", "vec_id", "v"])

    picked = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    picked = picked.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", F.isnull))
    return picked.mapInArrow(textscan.lean(run), "row long, vec_id long, v binary").filter("v is not null")


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and segment: mean * sqrt(size), and the length of the deviation from the mean."""
    d = x.shape[1]
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    size = np.diff(cuts)
    total, square = np.add.reduceat(x, cuts[:-1], axis=1), np.add.reduceat(x * x, cuts[:-1], axis=1)
    return total / np.sqrt(size), np.sqrt(np.maximum(0, square - total * total / size))


class Search:
    """The k best of all candidates seen, for queries of one length."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, k: int, least: np.ndarray):
        self.rows, self.x, self.k = rows, x, k
        self.least = least.copy()  # the k-th best known
        wide = x.astype(float)
        self.levels = [np.hstack(statistics(wide, s)) for s in LEVELS]
        self.norm = np.sqrt((wide**2).sum(axis=1))
        self.found = np.zeros((4, 0), np.int64)  # query, score, vec_id, row

    def exact(self, q: np.ndarray, y: np.ndarray, c: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Scores of pairs of queries q and rows c of y; bound: of each score's size, from the vectors' lengths."""
        out = np.empty(len(q), np.int64)
        for a in range(0, len(q), PAIRS):
            s = slice(a, a + PAIRS)
            out[s] = np.einsum("ij,ij->i", self.x[q[s]], y[c[s]])
        for i in np.flatnonzero(bound >= 2.0**62).tolist():  # may not fit 64 bits
            score = sum(a * b for a, b in zip(self.x[q[i]].tolist(), y[c[i]].tolist(), strict=True))
            out[i] = min(MOST, max(LEAST, score))
        return out

    def add(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        wide = y.astype(float)
        norm = np.sqrt((wide**2).sum(axis=1))
        own = [np.hstack(statistics(wide, segments)) for segments in LEVELS]
        new = [self._block(slice(a, a + BLOCK), rows, y, norm, own) for a in range(0, len(self.rows), BLOCK)]
        q, score, c = (np.concatenate(parts) for parts in zip(*new, strict=True))
        found = np.concatenate([self.found, np.stack([q, score, ids[c], rows[c]])], axis=1)
        found = found[:, np.lexsort((found[3], found[2], ~found[1], found[0]))]
        first = np.searchsorted(found[0], np.arange(len(self.rows)))
        place = np.arange(found.shape[1]) - first[found[0]]
        self.found = found[:, place < self.k]
        last = found[:, place == self.k - 1]
        self.least[last[0]] = np.maximum(self.least[last[0]], last[1])

    def _block(self, s: slice, rows: np.ndarray, y: np.ndarray, norm: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and candidate of the pairs that may be among the best, for a slice of the queries."""
        least = self.least[s].astype(float)
        least -= np.abs(least) * 1e-9
        least[self.least[s] == LEAST] = -np.inf
        q, c = np.nonzero(self.levels[0][s] @ own[0].T + (self.norm[s, None] * norm[None] * 1e-9 + 1e-6) >= least[:, None])
        q += s.start
        reach = self.norm[q] * norm[c]
        for level, other in zip(self.levels[1:], own[1:], strict=True):
            bound = np.concatenate([np.einsum("ij,ij->i", level[q[a : a + PAIRS]], other[c[a : a + PAIRS]]) for a in range(0, len(q), PAIRS)] or [np.zeros(0)])
            keep = bound + reach * 1e-9 + 1e-6 >= least[q - s.start]
            q, c, reach = q[keep], c[keep], reach[keep]
        score = self.exact(q, y, c, reach)
        keep = (score >= self.least[q]) & (self.rows[q] != rows[c])
        return q[keep], score[keep], c[keep]


def _matrix(values: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i8").reshape(len(values), d).astype(np.int64)


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    is_query: a function of the vec_id column that tells queries.
    """
    spark = vectors.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    all_rows = write_table(spark, quantised(vectors, vec_id, vector, scale), "vectors")
    queries = all_rows.filter(is_query(F.col("vec_id")))
    n = queries.count()
    out: DataFrame | None = None
    chunks = max(1, -(-n // CHUNK))
    for chunk in range(chunks):
        own = queries.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).collect()  # about CHUNK rows
        groups = []
        for d in sorted({len(r["v"]) // 8 for r in own}):
            same = sorted((r["row"], r["vec_id"], bytes(r["v"])) for r in own if len(r["v"]) == d * 8)
            rows, ids, x = np.array([r[0] for r in same]), np.array([r[1] for r in same]), _matrix([r[2] for r in same], d)
            first = Search(rows, x, k, np.full(len(rows), np.iinfo(np.int64).min))
            for a in range(0, min(SEEDS, len(rows)), 256):
                first.add(rows[a : a + 256], ids[a : a + 256], x[a : a + 256])
            groups.append((d, rows, ids, x, first.least))
        sent = spark.sparkContext.broadcast(groups)

        def run(batches, sent=sent):
            searches = {d: Search(rows, x, k, least) for d, rows, _, x, least in sent.value}
            for b in batches:
                raw = b.column(2).to_pylist()
                sizes = np.array([len(v) // 8 for v in raw])
                rows, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
                for d, search in searches.items():
                    at = np.flatnonzero(sizes == d)
                    for a in range(0, len(at), BLOCK):
                        part = at[a : a + BLOCK]
                        search.add(rows[part], ids[part], _matrix([raw[i] for i in part.tolist()], d))
            for d, rows, ids, _, _ in sent.value:
                q, score, found, _ = searches[d].found
                yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(ids[q]), pa.array(found), pa.array(score)], ["query_row", "query_id", "vec_id", "score"])

        part = all_rows.mapInArrow(textscan.lean(run), "query_row long, query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
