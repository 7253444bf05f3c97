"""Cluster-partitioned approximate search: k-means, assignment to centroids, and search in the nearest clusters.

Centroids are few (nlist), so they travel as literals or by broadcast; points are laid out by cluster, and a query's
clusters become a literal list, which prunes partitions at the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions import distance
from vecspark.operators.search import knn
from vecspark.plans.filters import Filter
from vecspark.session import arrow_udf


#: Files of a cluster at most, so that a large one isn't written by one task.
SPREAD = 8


def kmeans(points: DataFrame, k: int, max_iter: int = 20, tol: float = 1e-4, seed: int = 42, vector: str = "vector") -> np.ndarray:
    """At most k centroids (float32); k is cut to the number of points, without points there are none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k <= 0:
        raise ValueError("k must be positive")
    own = points.select(array_to_vector(points[vector].cast("array<double>")).alias("features"))
    n = own.limit(k).count()
    if n == 0:
        return np.zeros((0, 0), np.float32)
    if n == 1:
        return np.array([own.first()[0].toArray()], np.float32)
    model = KMeans(k=n, maxIter=max_iter, tol=tol, seed=seed).fit(own)
    return np.array(model.clusterCenters(), np.float32)


def centroid_means(points: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """label, dim, mean: the mean vector of each label, a row for each dimension."""
    rows = points.select(label, F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(vector: Column, centroids: np.ndarray, metric: str = "L2") -> Column:
    """The number of the nearest centroid; of equal ones the first."""
    kernel = distance.KERNELS[metric]

    @arrow_udf("int")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(kernel(np.stack(v.to_list()).astype(float), np.asarray(centroids, float)).argmin(axis=1) if len(v) else [], dtype="int32")

    return run(vector)


@dataclass
class IvfIndex:
    """points with a ``cluster`` column, and the centroids. probe is kept between 1 and their number."""

    points: DataFrame
    centroids: np.ndarray
    metric: str = "L2"
    probe: int = 8
    id_col: str = "id"
    vector_col: str = "vector"

    def __post_init__(self) -> None:
        self.set_probe(self.probe)

    def set_probe(self, probe: int) -> None:
        self.probe = max(1, min(probe, max(1, len(self.centroids))))

    def clusters(self, query: Sequence[float], probe: int | None = None) -> list[int]:
        if not len(self.centroids):
            return []
        far = distance.KERNELS[self.metric](np.asarray([query], float), self.centroids.astype(float))[0]
        return np.argsort(far, kind="stable")[: probe or self.probe].tolist()

    def search(self, query: Sequence[float], k: int, where: Filter | None = None, max_distance: float | None = None) -> DataFrame:
        """Exact within the nearest clusters. With a filter, more clusters are probed until k points are found."""
        probe = self.probe
        while True:
            near = self.points.filter(F.col("cluster").isin(self.clusters(query, probe))).drop("cluster")
            found = knn(near, query, k, self.metric, where, max_distance, self.id_col, self.vector_col)
            if where is None or probe >= len(self.centroids) or found.count() >= k:
                return found
            probe = min(len(self.centroids), probe * 8)

    def add(self, points: DataFrame) -> IvfIndex:
        """New points (ids replace), each in its nearest cluster."""
        old = self.points.join(points.select(self.id_col), self.id_col, "left_anti")
        new = points.withColumn("cluster", nearest_centroid(F.col(self.vector_col), self.centroids, self.metric))
        return IvfIndex(old.unionByName(new), self.centroids, self.metric, self.probe, self.id_col, self.vector_col)

    def remove(self, ids: Sequence) -> IvfIndex:
        return IvfIndex(self.points.filter(~F.col(self.id_col).isin(list(ids))), self.centroids, self.metric, self.probe, self.id_col, self.vector_col)

    def write(self, path: str) -> None:
        """A layout that a search prunes: one folder a cluster, of up to SPREAD files."""
        spread = F.pmod(F.xxhash64(self.id_col), F.lit(SPREAD))
        self.points.repartition("cluster", spread).write.mode("overwrite").partitionBy("cluster").parquet(path)

    def stored(self, path: str) -> IvfIndex:
        """The index on its own files: points stay assigned, and a search reads the folders of its clusters alone."""
        self.write(path)
        return replace(self, points=read_layout(self.points.sparkSession, path, self.points.schema))


def read_layout(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def build_ivf(points: DataFrame, nlist: int = 64, nprobe: int = 8, max_iter: int = 20, metric: str = "L2", id_col: str = "id", vector_col: str = "vector", centroids: np.ndarray | None = None, seed: int = 42) -> IvfIndex:
    if centroids is None:
        centroids = kmeans(points, nlist, max_iter, seed=seed, vector=vector_col)
    own = points.withColumn("cluster", nearest_centroid(F.col(vector_col), centroids, metric)) if len(centroids) else points.withColumn("cluster", F.lit(0))
    return IvfIndex(own, centroids, metric, nprobe, id_col, vector_col)
