"""Writing and reading points as DataFrame algebra: a change makes a new DataFrame, and the last change of an id wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.plans.filters import Filter, TypedPayload, VariantPayload, compiled, matching


def last_of_each(rows: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """The row of each id with the highest order."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(points: DataFrame, new: DataFrame, order: str | None = None, id_col: str = "id") -> DataFrame:
    """points with new rows, which replace those of the same id whole. order tells which of new's rows of an id wins."""
    if order is not None:
        new = last_of_each(new, order, id_col).drop(order)
    return points.join(new.select(id_col), id_col, "left_anti").select(*points.columns).unionByName(new)


def get(points: DataFrame, id, id_col: str = "id") -> DataFrame:
    return points.filter(F.col(id_col) == F.lit(id)).limit(1)


def delete(points: DataFrame, ids: Sequence | DataFrame, id_col: str = "id") -> DataFrame:
    """points without some ids; ids that don't exist are ignored."""
    if isinstance(ids, DataFrame):
        return points.join(ids.select(id_col), id_col, "left_anti")
    return points.filter(~F.col(id_col).isin(list(ids))) if ids else points


def delete_matching(points: DataFrame, where: Filter | None, payload: str | None = None) -> DataFrame:
    """points without those that match; no filter deletes all."""
    of = VariantPayload(points[payload]) if payload and points.schema[payload].dataType.typeName() == "variant" else TypedPayload(points, payload)
    return points.filter(~compiled(where, of, top=False))


def scroll(points: DataFrame, limit: int, after=None, where: Filter | None = None, id_col: str = "id", payload: str | None = None) -> DataFrame:
    """A page of points by id, strictly after an id; an id that doesn't exist gives an empty page, as does limit <= 0."""
    page = matching(points, where, payload)
    if after is not None:
        known = points.filter(F.col(id_col) == F.lit(after)).select(F.lit(1).alias("__known")).limit(1)
        page = page.filter(F.col(id_col) > F.lit(after)).join(F.broadcast(known), how="cross").drop("__known")  # one row or none
    return page.orderBy(id_col).limit(max(limit, 0))


def latest(base: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """The points after a change log (seq, op of UPSERT or DELETE, and the points' columns) on top of base.

    base is only filtered by the log's ids, not sorted; where the log is small enough, Spark broadcasts them.
    """
    last = last_of_each(log.withColumn("seq", F.col("seq").cast("long")), "seq", id_col).filter("op = 'UPSERT'").drop("seq", "op")
    return base.join(log.select(id_col).distinct(), id_col, "left_anti").select(*base.columns).unionByName(last)
