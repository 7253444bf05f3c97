"""Exact nearest-neighbour search.

A single query is a Column distance and ``orderBy().limit()`` (TakeOrderedAndProject: each task keeps k rows). A batch
of queries runs on matrices: each task keeps the k best of its rows for every query, so that only tasks * queries * k
rows are shuffled; queries go out in chunks of bounded size, and meet a task's rows in blocks of bounded size, so a
task's memory doesn't depend on how many rows and queries there are. Payload columns are joined to the winners afterwards
(hydrate), not carried through the search.

Ties are broken by id. k <= 0 gives no rows, but the query's dimension is still checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecspark.functions import distance
from vecspark.plans.filters import Filter, matching
from vecspark.session import ship

#: Queries broadcast at once, and what a task holds for them at most; rows, and pairs of rows and queries, that meet at once; pairs
#: whose exact distances are computed at once.
CHUNK, HELD, ROWS, BLOCK, PAIRS = 4096, 1 << 19, 2048, 1 << 20, 1 << 14


def check_query(query: Sequence[float], dimension: int | None) -> None:
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} components; the collection has {dimension}")


def knn(points: DataFrame, query: Sequence[float], k: int, metric: str = "L2", where: Filter | None = None, max_distance: float | None = None, id_col: str = "id", vector_col: str = "vector", payload: str | None = None, dimension: int | None = None) -> DataFrame:
    """The k nearest of the points that match: points' columns without the vector, and score; nearest first.

    The filter comes before the search, so there are k rows whenever k points match. max_distance is inclusive.
    """
    check_query(query, dimension)
    own = matching(points, where, payload).withColumn("score", distance.between(metric, points[vector_col], query)).drop(vector_col)
    if max_distance is not None:
        own = own.filter(F.col("score") <= max_distance)
    return own.orderBy("score", id_col).limit(max(k, 0))


def knn_range(points: DataFrame, query: Sequence[float], max_distance: float, k: int, **options) -> DataFrame:
    return knn(points, query, k, max_distance=max_distance, **options)


def vectors_of(column: pa.Array) -> np.ndarray:
    """A batch's vectors as a matrix of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def ids_of(column: pa.Array) -> np.ndarray:
    """A batch's ids: integers, or objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def places(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids; null comes first, as in Spark."""
    if ids.dtype != object:
        return ids
    values = ids.tolist()
    place = {v: i for i, v in enumerate(sorted(set(values), key=lambda v: (v is not None, v)))}
    return np.array([place[v] for v in values], np.int64)


class Nearest:
    """The k nearest of all rows seen, for a block of queries: query, id and score, in that order of queries and nearest first.

    The k-th best so far bounds what later rows are measured exactly. NaN is farther than all others.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, max_distance: float | None = None, kernel=None):
        self.queries, self.k, self.metric, self.max_distance, self.kernel = queries, k, metric, max_distance, kernel
        self.least = np.full(len(queries), np.inf if max_distance is None else max_distance, float)  # no farther ones count
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def exact(self, q: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of pairs of queries q and rows c of x."""
        return np.concatenate([distance.paired(self.metric, self.queries[q[a : a + PAIRS]], x[c[a : a + PAIRS]], self.kernel) for a in range(0, len(q), PAIRS)] or [np.zeros(0)])

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        far, limit = distance.ordered(self.metric, self.queries, x, self.kernel)
        near = far <= limit(self.least)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * self.k)
        if len(many) and len(x) > self.k:  # the distances of any k rows bound the k-th best
            c = np.argpartition(far[many], self.k - 1, axis=1)[:, : self.k]
            worst = self.exact(np.repeat(many, self.k), x, c.ravel()).reshape(len(many), self.k).max(axis=1)
            self.least[many] = np.fmin(self.least[many], worst)
            near[many] = far[many] <= limit(self.least)[many, None]
        q, c = np.nonzero(near)
        if not len(q):
            return
        score = self.exact(q, x, c)
        keep = ~(score > self.least[q])
        if self.max_distance is not None:
            keep &= score <= self.max_distance
        q, c, score = q[keep], c[keep], score[keep]
        all_q, all_id, all_s = np.concatenate([self.q, q]), np.concatenate([self.id, ids[c]]) if len(self.q) else ids[c], np.concatenate([self.score, score])
        order = np.lexsort((places(all_id), all_s, all_q))
        first = np.searchsorted(all_q[order], np.arange(len(self.queries)))
        place = np.arange(len(order)) - first[all_q[order]]
        last = order[place == self.k - 1]
        order = order[place < self.k]
        self.q, self.id, self.score = all_q[order], all_id[order], all_s[order]
        self.least[all_q[last]] = np.fmin(self.least[all_q[last]], all_s[last])


def knn_batch(points: DataFrame, queries: DataFrame, k: int, metric: str = "L2", where: Filter | None = None, max_distance: float | None = None, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query", payload: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), the point's id and score for each query, exact.

    Each chunk of at most ``chunk`` queries (fewer for a large k) is broadcast: a stated set against all rows, in blocks.
    """
    spark = points.sparkSession
    ship(spark)
    own = matching(points, where, payload).select(points[id_col].alias("id"), points[vector_col].alias("vector"))
    id_type, query_type = points.schema[id_col].dataType, queries.schema[query_id].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    kernel = None if metric in distance.METRICS else distance.KERNELS[metric]  # goes out with the function: workers don't know what was registered
    n = queries.count() if k > 0 else 0
    chunk = max(1, min(chunk, HELD // max(1, k)))
    parts = max(1, -(-n // chunk))
    out = None
    for part in range(parts):
        asked = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        rows = asked.select(query_id, query_vector).collect() if n else []
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float) if rows else np.zeros((0, 0))))

        def best(batches, sent=sent):
            names, q = sent.value
            size = max(1, BLOCK // ROWS // (1 if metric in distance.METRICS else max(1, q.shape[1])))  # other kernels may need room for each component
            blocks = [Nearest(q[a : a + size], k, metric, max_distance, kernel) for a in range(0, len(q), size)]
            for b in batches:
                for a in range(0, b.num_rows if blocks else 0, ROWS):
                    some = b.slice(a, ROWS)
                    x, ids = vectors_of(some.column(1)), ids_of(some.column(0))
                    if x.shape[1] != q.shape[1]:
                        raise ValueError("vectors differ in length")
                    for block in blocks:
                        block.add(ids, x)
            for i, block in enumerate(blocks):
                frame = pa.table({"query_id": [names[j] for j in (block.q + i * size).tolist()], "id": block.id.tolist(), "score": block.score})
                yield from frame.cast(arrow).to_batches()

        found = own.mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def hydrate(found: DataFrame, points: DataFrame, id_col: str = "id", columns: Sequence[str] = ()) -> DataFrame:
    """Adds payload columns to search results by id."""
    return found.join(points.select(F.col(id_col).alias("id"), *columns), "id")
