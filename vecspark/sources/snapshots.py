"""Points as JSON: snapshots, rows of a request, and results for a response."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.sources.store import POINT


def write_snapshot(points: DataFrame, path: str) -> None:
    """One JSON object a line: id, vector, payload (as JSON inside)."""
    points.select(*POINT.names).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT).json(path)


def from_requests(spark: SparkSession, points: Iterable[dict]) -> DataFrame:
    """Points from parsed JSON objects; ids of any JSON type become strings, numbers become float32."""
    rows = []
    for i, p in enumerate(points):
        if not isinstance(p, dict) or p.get("id") is None or not isinstance(p.get("vector"), list):
            raise ValueError(f"points[{i}] needs an id and a vector")
        rows.append((str(p["id"]), [float(x) for x in p["vector"]], json.dumps(p.get("payload") or {}, ensure_ascii=False)))
    return spark.createDataFrame(rows, POINT)


def to_results(found: DataFrame) -> list[dict]:
    """Search results (a top-k list) as JSON objects; an empty payload is left out."""
    out = []
    for r in found.select("id", F.col("score").cast("double"), "payload").collect():
        payload = json.loads(r["payload"] or "{}")
        out.append({"id": r["id"], "score": r["score"], **({"payload": payload} if payload else {})})
    return out
