"""Stores of collections. A collection is a DataFrame of points (id, vector, payload as JSON) plus one catalog entry.

MemoryStore keeps DataFrames; PersistentStore keeps, under one folder that all executors share,

* ``catalog/<collection>/rev=<n>``: the schema, the index parameters and which base version and log are current,
* ``base/<collection>/v=<n>``: a compacted version of the points as Parquet,
* ``log/<collection>/seq=<n>``: one folder a change, written before the change counts as made.

The points are the base with the log on top, the last change of an id winning: opening a store replays nothing. After
``checkpoint_every`` changes (a batch is one) or flush(), a new base version is written and the log starts anew. All
reads and writes go through Spark and Hadoop file systems, so any path that they reach will do. A change that was cut
off has no _SUCCESS file and doesn't count.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.distance import METRICS
from vecspark.operators import points as ops
from vecspark.operators.graph import build_graphs, search_graphs
from vecspark.operators.ivf import IvfIndex, build_ivf, read_layout
from vecspark.operators.search import hydrate, knn, knn_batch
from vecspark.plans.filters import Filter, VariantPayload, compiled, parse_filter
from vecspark.session import shared_dir, ship, write_table

POINT = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType()), False), T.StructField("payload", T.StringType())])
CLUSTERED = T.StructType([*POINT.fields, T.StructField("cluster", T.IntegerType())])
CENTROID, GRAPH = "cluster int, centroid array<float>", "part int, graph binary, n long"
INDEXES = ("FLAT", "HNSW", "IVF")
#: Default parameters by index type.
PARAMETERS = {"FLAT": {}, "HNSW": {"M": 16, "efConstruction": 200, "efSearch": 50}, "IVF": {"nlist": 64, "nprobe": 8, "maxIter": 20}}


class StoreError(RuntimeError):
    """A collection or store isn't in the state that a call needs."""


def index_parameters(index: str, given: dict[str, Any] | None) -> dict[str, int]:
    """The parameters of an index type: numbers or numerals; blanks and nothing mean the default."""
    if index not in PARAMETERS:
        raise ValueError(f"unknown index type {index}")
    out = dict(PARAMETERS[index])
    for name, value in (given or {}).items():
        if name in out and value is not None and str(value).strip():
            out[name] = int(float(value))
    return out


@dataclass(frozen=True)
class Schema:
    name: str
    dimension: int
    metric: str = "L2"
    index: str = "FLAT"
    parameters: dict[str, Any] = field(default_factory=dict)
    description: str = ""
    created: int = 0


def make_schema(name: str, dimension: int, metric: str, index: str, parameters: dict | None, description: str | None) -> Schema:
    if not name:
        raise ValueError("a collection needs a name")
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return Schema(name, dimension, metric, index, index_parameters(index, parameters), description or "", int(time.time() * 1000))


class MemoryStore:
    """A store whose collections live as DataFrames (checkpointed to the shared folder when their plans grow)."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.schemas: dict[str, Schema] = {}
        self.frames: dict[str, DataFrame] = {}
        self.built: dict[str, Any] = {}
        self.default: tuple[str, dict] | None = None
        self.open = True

    # collections

    def create(self, name: str, dimension: int, metric: str = "L2", index: str | None = None, parameters: dict | None = None, description: str | None = None) -> Schema:
        self._alive()
        if self.has(name):
            raise StoreError(f"collection {name} exists")
        if index is None:
            index, parameters = self.default or ("FLAT", {})
        schema = make_schema(name, dimension, metric, index, parameters, description)
        self._new(schema)
        return schema

    def set_default_index(self, index: str | None, parameters: dict | None = None) -> None:
        """The index type of collections created without one; None clears it."""
        self._alive()
        self.default = None if index is None else (index, index_parameters(index, parameters))

    def schema(self, name: str) -> Schema | None:
        self._alive()
        return self.schemas.get(name)

    def has(self, name: str) -> bool:
        return self.schema(name) is not None

    def names(self) -> list[str]:
        self._alive()
        return sorted(self.schemas)

    def drop(self, name: str) -> bool:
        self._alive()
        if name not in self.schemas:
            return False
        del self.schemas[name]
        self.built.pop(name, None)
        self._remove(name)
        return True

    # points

    def points(self, name: str) -> DataFrame:
        """All live points: id, vector, payload (JSON)."""
        self._need(name)
        return self._points(name)

    def upsert(self, name: str, id: str, vector: Sequence[float], payload: dict | None = None) -> None:
        self.upsert_batch(name, [(id, vector, payload)])

    def upsert_batch(self, name: str, rows: Sequence[tuple] | DataFrame, order: str | None = None) -> None:
        """Insert or replace points whole; of rows of one id the last wins. The whole batch is checked first.

        The rows of a DataFrame have no order but that of a column: order names it, and the highest of an id wins.
        Without it, ids that occur twice are refused.
        """
        schema = self._need(name)
        if isinstance(rows, DataFrame):
            if order is not None:
                rows = ops.last_of_each(rows, order)
            elif twice := rows.groupBy("id").count().filter("count > 1").first():
                raise ValueError(f"id {twice['id']} occurs {twice['count']} times; name an order column")
            checked = rows.withColumn("vector", F.when(F.size("vector") == schema.dimension, F.col("vector")).otherwise(F.raise_error(F.lit("wrong dimension")).cast("array<float>")))
            self._change(name, checked.select(*POINT.names))
            return
        if not rows:
            return
        last: dict[str, tuple] = {}
        for id, vector, payload in rows:
            if id is None or vector is None or len(vector) != schema.dimension:
                raise ValueError(f"point {id} doesn't have {schema.dimension} components")
            last.pop(str(id), None)
            last[str(id)] = (str(id), [float(x) for x in vector], json.dumps(payload or {}, ensure_ascii=False, default=str))
        self._change(name, self.spark.createDataFrame(list(last.values()), POINT))

    def get(self, name: str, id: str) -> dict | None:
        self._need(name)
        row = ops.get(self._points(name), id).first()
        return row and {"id": row["id"], "vector": list(row["vector"]), "payload": json.loads(row["payload"] or "{}")}

    def delete(self, name: str, id: str) -> bool:
        found = self.get(name, id) is not None
        if found:
            self.delete_many(name, [id])
        return found

    def delete_many(self, name: str, ids: Sequence[str]) -> None:
        self._need(name)
        if ids:
            self._delete(name, self.spark.createDataFrame([(str(i),) for i in ids], "id string"))

    def delete_by_filter(self, name: str, where: Filter | dict | None) -> int:
        self._need(name)
        own = self._points(name)
        gone = own.filter(compiled(self._filter(where), VariantPayload(F.try_parse_json("payload")), top=False)).select("id")
        n = gone.count()
        if n:
            self._delete(name, gone)
        return n

    def scroll(self, name: str, limit: int, after: str | None = None, where: Filter | dict | None = None) -> DataFrame:
        self._need(name)
        return ops.scroll(self._points(name), limit, after, self._filter(where), payload="payload")

    def count(self, name: str) -> int:
        """The number of points; 0 for a collection that doesn't exist."""
        self._alive()
        return self._points(name).count() if name in self.schemas else 0

    def clear(self, name: str) -> None:
        self.delete_by_filter(name, None)

    # search

    def search(self, name: str, query: Sequence[float], k: int, where: Filter | dict | None = None, max_distance: float | None = None) -> DataFrame:
        """id, score, payload; exact unless build_index() has made an approximate index that is up to date."""
        schema = self._need(name)
        f = self._filter(where)
        if len(query) != schema.dimension:
            raise ValueError(f"the query has {len(query)} components; the collection has {schema.dimension}")
        index = self.built.get(name)
        if index is not None and f is None and max_distance is None and k > 0:
            if schema.index == "IVF":
                return index.search(query, k).select("id", F.col("score").cast("float").alias("score"), "payload")
            found = search_graphs(index, query, k, schema.parameters["efSearch"])
            return hydrate(found, self._points(name), columns=["payload"]).orderBy("score", "id").select("id", F.col("score").cast("float").alias("score"), "payload")
        found = knn(self._points(name), query, k, schema.metric, f, max_distance, payload="payload")
        return found.select("id", F.col("score").cast("float").alias("score"), "payload")

    def search_range(self, name: str, query: Sequence[float], max_distance: float, k: int, where: Filter | dict | None = None) -> DataFrame:
        return self.search(name, query, k, where, max_distance)

    def search_batch(self, name: str, queries: Sequence[Sequence[float]], k: int, where: Filter | dict | None = None) -> DataFrame:
        """query (its place in the list), rank, id, score."""
        schema = self._need(name)
        if any(len(q) != schema.dimension for q in queries):
            raise ValueError(f"the collection has {schema.dimension} components")
        asked = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query_id int, query array<float>")
        return knn_batch(self._points(name), asked, k, schema.metric, self._filter(where), payload="payload").withColumnRenamed("query_id", "query")

    def build_index(self, name: str) -> None:
        """Build the index on files of its own, which later changes and checkpoints of the points leave alone."""
        schema = self._need(name)
        own, p = self._points(name), schema.parameters
        if schema.index == "FLAT":
            self.built[name] = None
            return
        path = self._index_path(name)
        if schema.index == "IVF":
            index = build_ivf(own, p["nlist"], p["nprobe"], p["maxIter"], schema.metric)
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], CENTROID).coalesce(1).write.parquet(f"{path}/centroids")
            self.built[name] = index.stored(f"{path}/points")
        else:
            build_graphs(own, schema.metric, p["M"], p["efConstruction"]).write.parquet(f"{path}/graphs")
            self.built[name] = self._load_index(schema, path)
        self._indexed(name, path)

    def _load_index(self, schema: Schema, path: str):
        if schema.index == "IVF":
            rows = self.spark.read.schema(CENTROID).parquet(f"{path}/centroids").orderBy("cluster").collect()  # nlist rows
            centroids = np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), -1)
            return IvfIndex(read_layout(self.spark, f"{path}/points", CLUSTERED), centroids, schema.metric, schema.parameters["nprobe"])
        return self.spark.read.schema(GRAPH).parquet(f"{path}/graphs")

    def _index_path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/vecspark/index-{uuid.uuid4().hex[:12]}"

    def _indexed(self, name: str, path: str) -> None:
        pass

    def is_indexed(self, name: str) -> bool:
        """Whether the index was built and nothing was written since."""
        self._need(name)
        return name in self.built

    def index_type(self, name: str) -> str:
        return self._need(name).index

    def switch_index(self, name: str, index: str, parameters: dict | None = None) -> None:
        self.schemas[name] = replace(self._need(name), index=index, parameters=index_parameters(index, parameters))
        self._saved(name)
        self.build_index(name)

    # life cycle

    def flush(self, name: str | None = None) -> None:
        self._alive()
        for n in self.names():
            if n not in self.built:
                self.build_index(n)

    def close(self) -> None:
        self.open = False

    @property
    def is_closed(self) -> bool:
        return not self.open

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def stats(self) -> DataFrame:
        """collection, dimension, metric, index_type, points."""
        rows = [(s.name, s.dimension, s.metric, s.index, self.count(s.name)) for s in map(self.schema, self.names())]
        return self.spark.createDataFrame(rows, "collection string, dimension int, metric string, index_type string, points long")

    # inside

    def _alive(self) -> None:
        if not self.open:
            raise StoreError("the store is closed")

    def _need(self, name: str) -> Schema:
        schema = self.schema(name)
        if schema is None:
            raise StoreError(f"there is no collection {name}")
        return schema

    @staticmethod
    def _filter(where: Filter | dict | None) -> Filter | None:
        return parse_filter(where) if isinstance(where, dict) else where

    def _new(self, schema: Schema) -> None:
        self.schemas[schema.name] = schema
        self.frames[schema.name] = self.spark.createDataFrame([], POINT)

    def _saved(self, name: str) -> None:
        pass

    def _remove(self, name: str) -> None:
        del self.frames[name]

    def _points(self, name: str) -> DataFrame:
        return self.frames[name]

    def _settle(self, name: str, df: DataFrame) -> None:
        self.frames[name] = write_table(self.spark, df, "collection")
        self.built.pop(name, None)

    def _change(self, name: str, new: DataFrame) -> None:
        self._settle(name, ops.upsert(self._points(name), new))

    def _delete(self, name: str, ids: DataFrame) -> None:
        self._settle(name, ops.delete(self._points(name), ids))

    def apply(self, name: str, changes: DataFrame) -> None:
        """Upserts and deletes (op, id, vector, payload; an id once) as one change."""
        self._need(name)
        new = changes.filter("op = 'UPSERT'").select(*POINT.names)
        self._settle(name, ops.delete(self._points(name), changes).unionByName(new))


class PersistentStore(MemoryStore):
    def __init__(self, spark: SparkSession, path: str, checkpoint_every: int = 1000):
        super().__init__(spark)
        self.path, self.checkpoint_every = path.rstrip("/"), checkpoint_every
        self.state: dict[str, dict[str, Any]] = {}
        self._recover()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _children(self, path: str, done: bool = True) -> list[str]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [n for n in names if not done or fs.exists(self._fs(f"{path}/{n}/_SUCCESS")[1])]

    def _numbers(self, path: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._children(path) if "=" in n)

    def _recover(self) -> None:
        for name in self._children(f"{self.path}/catalog", done=False):
            revisions = self._numbers(f"{self.path}/catalog/{name}")
            if revisions:
                entry = json.loads(self.spark.read.text(f"{self.path}/catalog/{name}/rev={revisions[-1]}").first()[0])
                self.state[name] = entry["state"] | {"rev": revisions[-1]}
                self.schemas[name] = Schema(**entry["schema"])
                if "index" in entry["state"] and entry["state"]["index"]["after"] == self._last(name):  # nothing was written since
                    self.built[name] = self._load_index(self.schemas[name], entry["state"]["index"]["path"])

    def _last(self, name: str) -> int:
        """The number of the last change."""
        return max([self.state[name]["first"] - 1, *self._pending(name)])

    def _index_path(self, name: str) -> str:
        old = [int(n.split("=")[1]) for n in self._children(f"{self.path}/index/{name}", done=False)]
        return f"{self.path}/index/{name}/n={max(old, default=-1) + 1}"

    def _indexed(self, name: str, path: str) -> None:
        """The catalog's new revision puts the new index in place of the old one at once; the one before that goes."""
        self.state[name]["index"] = {"path": path, "after": self._last(name)}
        self._saved(name)
        head, number = path.rsplit("=", 1)
        fs, p = self._fs(f"{head}={int(number) - 2}")
        fs.delete(p, True)

    def _saved(self, name: str) -> None:
        state = self.state[name]
        state["rev"] += 1
        entry = json.dumps({"schema": asdict(self.schemas[name]), "state": {k: v for k, v in state.items() if k != "rev"}})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/catalog/{name}/rev={state['rev']}")

    def _new(self, schema: Schema) -> None:
        self.schemas[schema.name], self.state[schema.name] = schema, {"rev": -1, "version": 0, "first": 0}
        self.spark.createDataFrame([], POINT).write.mode("overwrite").parquet(f"{self.path}/base/{schema.name}/v=0")
        self._saved(schema.name)

    def _remove(self, name: str) -> None:
        del self.state[name]
        for part in ("catalog", "base", "log", "index"):
            fs, p = self._fs(f"{self.path}/{part}/{name}")
            fs.delete(p, True)

    def _pending(self, name: str) -> list[int]:
        return [n for n in self._numbers(f"{self.path}/log/{name}") if n >= self.state[name]["first"]]

    def changes(self, name: str) -> DataFrame | None:
        """The change log since the last checkpoint: seq, op, id, vector, payload."""
        own = self._pending(name)
        if not own:
            return None
        log = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(f.name, f.dataType) for f in POINT.fields]])
        rows = self.spark.read.schema(log).option("basePath", f"{self.path}/log/{name}").parquet(*[f"{self.path}/log/{name}/seq={n}" for n in own])
        return rows.withColumn("seq", F.regexp_extract(F.input_file_name(), "seq=(\\d+)", 1).cast("long"))

    def _points(self, name: str) -> DataFrame:
        base = self.spark.read.schema(POINT).parquet(f"{self.path}/base/{name}/v={self.state[name]['version']}")
        log = self.changes(name)
        return base if log is None else ops.latest(base, log)

    def _append(self, name: str, rows: DataFrame) -> None:
        last = [int(n.split("=")[1]) for n in self._children(f"{self.path}/log/{name}", done=False) if "=" in n]  # cut-off ones too
        seq = max([self.state[name]["first"] - 1, *last]) + 1
        rows.select("op", *POINT.names).write.mode("errorifexists").parquet(f"{self.path}/log/{name}/seq={seq}")  # another writer's change stays
        self.built.pop(name, None)
        if len(self._pending(name)) >= self.checkpoint_every:
            self._checkpoint(name)

    def _change(self, name: str, new: DataFrame) -> None:
        self._append(name, new.withColumn("op", F.lit("UPSERT")))

    def _delete(self, name: str, ids: DataFrame) -> None:
        self._append(name, ids.select(F.lit("DELETE").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload")))

    def apply(self, name: str, changes: DataFrame) -> None:
        self._need(name)
        self._append(name, changes)

    def _checkpoint(self, name: str) -> None:
        """A new base version. The version before and its log stay until the next one: DataFrames at hand still read them."""
        own = self._pending(name)
        if not own:
            return
        state = self.state[name]
        version = state["version"] + 1
        self._points(name).write.mode("overwrite").parquet(f"{self.path}/base/{name}/v={version}")
        gone = [n for n in self._numbers(f"{self.path}/log/{name}") if n < state["first"]]
        state |= {"version": version, "first": own[-1] + 1}
        self._saved(name)
        for path in [f"{self.path}/base/{name}/v={version - 2}", *[f"{self.path}/log/{name}/seq={n}" for n in gone]]:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def flush(self, name: str | None = None) -> None:
        """A checkpoint of all collections."""
        self._alive()
        for n in self.names():
            self._checkpoint(n)

    def close(self) -> None:
        if self.open:
            self.flush()
        super().close()


def open_store(spark: SparkSession, path: str | None = None, **options) -> MemoryStore:
    """A store in memory, or under a folder."""
    return MemoryStore(spark) if path is None else PersistentStore(spark, path, **options)
