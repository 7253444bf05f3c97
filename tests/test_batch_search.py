"""Batches of queries: a task's memory, and results against brute force where distances tie, overflow or nearly cancel."""

import threading

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from vecspark.functions import distance
from vecspark.operators.search import Nearest, knn_batch
from vecspark.plans import filters as f


def wave(spark, n, name):
    """n vectors in one partition, and so in one batch of rows."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias(f"{name}_id"), F.array(*[F.sin(F.col("id") * (j + 1) * 0.37) for j in range(8)]).cast("array<float>").alias(name), F.lit("en").alias("lang"))


def growth(run) -> float:
    """MB by which the Python worker that grows most has grown while ``run`` runs."""
    most, done = [0.0], threading.Event()
    rss = lambda: {p.pid: p.memory_info().rss / 1e6 for p in psutil.Process().children(recursive=True) if "python" in p.name()}
    first = rss()

    def watch():
        while not done.wait(0.01):
            try:
                most[0] = max([most[0], *(mb - first.get(pid, 0) for pid, mb in rss().items())])
            except psutil.Error:
                pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        run()
    finally:
        done.set()
        watcher.join()
    return most[0]


@pytest.mark.parametrize(("metric", "where"), [("COSINE", None), ("L2", None), ("IP", None), ("L2", f.eq("lang", "en")), ("HAMMING", None)])
def test_memory_of_a_task(spark, metric, where):
    """10,000 rows that meet 4,000 queries: a matrix of all their distances alone has 320 MB."""
    own, asked = wave(spark, 10_000, "vector").withColumnRenamed("vector_id", "id"), wave(spark, 4_000, "query")
    assert growth(lambda: knn_batch(own, asked, 10, metric, where).count()) < 350


def brute(metric, q, x, ids, k, max_distance):
    out = []
    for i in range(len(q)):
        d = distance.paired(metric, np.repeat(q[i : i + 1], len(x), 0), x)
        order = np.lexsort((ids, d))
        out += [(i, ids[j]) for j in order if max_distance is None or d[j] <= max_distance][:k]
    return out


@pytest.mark.parametrize("metric", distance.METRICS)
@pytest.mark.parametrize("kind", ["plain", "ties", "one", "close", "odd"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_blocks_are_brute_force(metric, kind):
    rng = np.random.default_rng(7)
    for k, scale, bounded in ((1, 1, False), (7, 1e6, True), (10, 1e-4, False)):
        x = rng.normal(size=(600, 5)) * scale
        if kind == "ties":
            x = np.round(x / scale)
        elif kind == "one":
            x[:] = x[0]
        elif kind == "close":
            x = x[rng.integers(0, 15, 600)] * (1 + 1e-7 * rng.normal(size=(600, 5)))
        elif kind == "odd":
            x[::97], x[5::97, 0], x[9::97], x[13::97] = np.nan, np.inf, 0, 1e-100
        x = x.astype(np.float32).astype(float)
        q, ids = x[::17], rng.permutation(600)
        limit = float(np.nanmedian(distance.paired(metric, q, x[: len(q)]))) if bounded else None
        nearest = Nearest(q, k, metric, limit)
        for a in range(0, 600, 110):
            nearest.add(ids[a : a + 110], x[a : a + 110])
        assert list(zip(nearest.q.tolist(), nearest.id.tolist(), strict=True)) == brute(metric, q, x, ids, k, limit)


def test_ids_and_registered_distances(spark):
    distance.register("TAXI", lambda q, x: np.abs(q[:, None] - x[None]).sum(axis=2))
    own = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [0.5, 0.5]), ("c", [9.0, 9.0])], "id string, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([("x", [0.0, 0.0]), ("y", [9.0, 9.0])], "query_id string, query array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in knn_batch(own, asked, 2, "TAXI").collect()}
    assert got == {("x", 1): (None, 1.0), ("x", 2): ("a", 1.0), ("y", 1): ("c", 0.0), ("y", 2): (None, 17.0)}
    assert knn_batch(own, asked, 0, "TAXI").count() == 0 and knn_batch(own, asked.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        knn_batch(own, spark.createDataFrame([(1, [1.0])], "query_id int, query array<float>"), 2).collect()
