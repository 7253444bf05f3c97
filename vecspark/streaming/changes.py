"""Change events as a stream: micro-batches of upserts and deletes are applied to a store, each batch once.

An event is (seq, op, id, vector, payload), op being UPSERT or DELETE; within a batch the highest seq of an id wins.
A batch that is delivered again (after a failure) changes nothing: its events are the same and the last of an id wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.points import last_of_each
from vecspark.sources.store import MemoryStore

EVENT = "seq long, op string, id string, vector array<float>, payload string"


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_batch(store: MemoryStore, collection: str, events: DataFrame) -> None:
    last = last_of_each(events, "seq").filter("op in ('UPSERT', 'DELETE')")
    size = store.schema(collection).dimension
    fit = F.when((F.col("op") == "DELETE") | (F.size("vector") == size), F.col("vector")).otherwise(F.raise_error(F.lit("wrong dimension")).cast("array<float>"))
    store.apply(collection, last.select("op", "id", fit.alias("vector"), F.coalesce("payload", F.lit("{}")).alias("payload")))


def follow(store: MemoryStore, collection: str, changes: DataFrame, checkpoint: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Apply a stream of events to a collection; checkpoint is a folder that outlives the query."""
    writer = changes.writeStream.foreachBatch(lambda events, _: apply_batch(store, collection, events)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
