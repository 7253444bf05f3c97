"""Fusion of ranked result lists (channels) into one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Channel:
    """A result list: id, rank (from 1), score and any payload column. Without rank, rows are ranked by score."""

    results: DataFrame | None
    weight: float = 1.0
    ascending: bool = True

    def ranked(self) -> DataFrame:
        if "rank" in self.results.columns:
            return self.results
        order = F.col("score").asc() if self.ascending else F.col("score").desc()
        return self.results.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))  # a top-k list


def fuse(channels: Sequence[Channel | None], share: Column, top_k: int, name: str, payload: str | None = None) -> DataFrame | None:
    """share: what a row gives to its id's fused score, from the columns weight and rank.

    The output's score is the least raw score of the id; the payload comes from its first channel. top_k <= 0: all.
    None if no channel has a positive weight.
    """
    used = [c for c in channels if c is not None and c.results is not None and c.weight > 0]
    if not used:
        return None
    keep = [payload] if payload else []
    parts = [c.ranked().select("id", "rank", F.col("score").cast("double").alias("score"), *keep).withColumns({"weight": F.lit(float(c.weight)), "channel": F.lit(i)}) for i, c in enumerate(used)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = [F.min_by(payload, F.struct("channel", "rank")).alias(payload)] if payload else []
    out = rows.groupBy("id").agg(F.sum(share).alias(name), F.min("score").alias("score"), *first).orderBy(F.desc(name), "id")
    return out.limit(top_k) if top_k > 0 else out


def rrf(channels: Sequence[Channel | None], top_k: int = 0, k: float = 60, payload: str | None = None) -> DataFrame | None:
    """Reciprocal rank fusion: the sum of weight / (k + rank), as rrf_score."""
    return fuse(channels, F.col("weight") / (F.lit(float(k)) + F.col("rank")), top_k, "rrf_score", payload)


def weighted(channels: Sequence[Channel | None], top_k: int = 0, payload: str | None = None) -> DataFrame | None:
    """The sum of weight / rank, as weighted_score."""
    return fuse(channels, F.col("weight") / F.col("rank"), top_k, "weighted_score", payload)
