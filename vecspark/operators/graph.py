"""Graph-based approximate search: a proximity graph for each part of the points, built and searched inside tasks.

Points are dealt into parts of bounded size by a hash of the id; each part gets a graph of its own (layered for the
HNSW kind, flat for the Vamana kind), stored as one packed row. A search runs a beam through every part's graph and the
parts' winners are merged by a global top k. Parts are independent, so build and search scale with tasks, and a lost
executor costs its parts only.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import distance
from vecspark.session import ship, write_table

#: Points of a part at most, about; a graph's memory is bounded by it. Fewer points make a part for each core, from LEAST points on.
PART, LEAST = 20_000, 250


@dataclass
class Graph:
    """Neighbour lists over the rows of one matrix. layers[0] has every node; higher layers have fewer."""

    metric: str
    degree: int
    build_beam: int
    layered: bool = True
    seed: int = 0
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    layers: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    entry: int = -1

    def _far(self, q: np.ndarray, rows: Sequence[int]) -> np.ndarray:
        return distance.KERNELS[self.metric](q[None], self.x[rows])[0]

    def beam(self, q: np.ndarray, start: Sequence[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first walk from start meets, nearest first."""
        seen = set(start)
        first = [(float(d), i) for d, i in zip(self._far(q, list(start)), start, strict=True)]
        frontier, best = list(first), [(-d, i) for d, i in first]
        heapq.heapify(frontier)
        heapq.heapify(best)
        edges = self.layers[layer]
        while frontier:
            d, at = heapq.heappop(frontier)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [j for j in edges.get(at, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(self._far(q, fresh).tolist(), fresh, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(frontier, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """At most ``most`` of the candidates: those nearer to the point than to any chosen one, then the nearest left."""
        chosen: list[int] = []
        left: list[int] = []
        for d, i in found:
            if len(chosen) == most:
                break
            (chosen if not chosen or (self._far(self.x[i], chosen) > d).all() else left).append(i)
        return (chosen + left)[:most]

    def build(self, x: np.ndarray) -> Graph:
        self.x = x
        rng = np.random.default_rng(self.seed)
        tops = np.minimum(16, (-np.log(1 - rng.random(len(x))) / math.log(max(2, self.degree))).astype(int)) if self.layered else np.zeros(len(x), int)
        for i in range(len(x)):
            self._insert(i, int(tops[i]))
        return self

    def _insert(self, i: int, top: int) -> None:
        while len(self.layers) <= top:
            self.layers.append({})
        if self.entry < 0:
            for layer in range(top + 1):
                self.layers[layer][i] = []
            self.entry = i
            return
        start, height = [self.entry], max(k for k, edges in enumerate(self.layers) if self.entry in edges)
        for layer in range(height, top, -1):
            start = [self.beam(self.x[i], start, 1, layer)[0][1]]
        for layer in range(min(top, height), -1, -1):
            most = self.degree * (2 if layer == 0 else 1)
            found = self.beam(self.x[i], start, self.build_beam, layer)
            own = self.diverse(found, most)
            edges = self.layers[layer]
            edges[i] = own
            for j in own:
                edges[j].append(i)
                if len(edges[j]) > most:
                    near = sorted(zip(self._far(self.x[j], edges[j]).tolist(), edges[j], strict=True))
                    edges[j] = self.diverse(near, most)
            start = [j for _, j in found]
        for layer in range(height + 1, top + 1):
            self.layers[layer][i] = []
        if top > height:
            self.entry = i

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for layer in range(max(k2 for k2, edges in enumerate(self.layers) if self.entry in edges), 0, -1):
            start = [self.beam(q, start, 1, layer)[0][1]]
        return self.beam(q, start, max(beam, k), 0)[:k]


def build_graphs(points: DataFrame, metric: str = "L2", degree: int = 16, build_beam: int = 200, layered: bool = True, id_col: str = "id", vector_col: str = "vector", part: int = PART) -> DataFrame:
    """part, graph (packed), n: one row a part, in a table under the shared folder."""
    spark = points.sparkSession
    ship(spark)
    n = points.count()
    parts = max(1, -(-n // part), min(spark.sparkContext.defaultParallelism, n // LEAST))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        graph = Graph(metric, degree, build_beam, layered, seed=int(pdf["part"].iloc[0])).build(np.stack(pdf["vector"].to_list()).astype(float))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "graph": [pickle.dumps((pdf["id"].to_list(), graph))], "n": [len(pdf)]})

    own = points.select(points[id_col].alias("id"), points[vector_col].alias("vector"), F.pmod(F.xxhash64(points[id_col]), F.lit(parts)).cast("int").alias("part"))
    own = own.repartitionById(parts, "part")  # a task each
    return write_table(spark, own.groupBy("part").applyInPandas(build, "part int, graph binary, n long"), "graphs")


def search_graphs(graphs: DataFrame, query: Sequence[float], k: int, beam: int = 50, id_type: str = "string") -> DataFrame:
    """id, score of the k nearest that the walks find."""
    ship(graphs.sparkSession)
    q = np.asarray(query, float)

    def search(frames):
        for pdf in frames:
            rows = [(ids[i], d) for raw in pdf["graph"] for ids, graph in [pickle.loads(raw)] for d, i in graph.search(q, k, beam)]
            yield pd.DataFrame(rows, columns=["id", "score"])

    return graphs.select("graph").mapInPandas(search, f"id {id_type}, score double").orderBy("score", "id").limit(max(k, 0))


def edges(graphs: DataFrame, id_type: str = "string") -> DataFrame:
    """The graphs as a table: part, layer, id, neighbours, entry."""
    ship(graphs.sparkSession)

    def spread(frames):
        for pdf in frames:
            rows = [(int(p), layer, ids[i], [ids[j] for j in near], i == graph.entry) for p, raw in zip(pdf["part"], pdf["graph"], strict=True) for ids, graph in [pickle.loads(raw)] for layer, table in enumerate(graph.layers) for i, near in table.items()]
            yield pd.DataFrame(rows, columns=["part", "layer", "id", "neighbours", "entry"])

    return graphs.select("part", "graph").mapInPandas(spread, f"part int, layer int, id {id_type}, neighbours array<{id_type}>, entry boolean")
