"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes one sorted run: its distinct digests, each with the best row and the number of rows. Runs
are merged in rounds; in a round, runs whose numbers agree but for the last binary digits (``fan_in`` is a power of
two, so a round is log2(fan_in) binomial rounds at once) are exchanged slice by slice of the digest range, merged
multiway in digest order, and of equal digests the best row and the summed count stay. A run is ordered by the digest's
leading 64 bits and equality is verified on all 256, at every level. After the last round each digest occurs once.
The result goes back down the tree to the rows by (digest, run), so a digest that a third of all rows share never
meets in one task: one run has at most one row of it on the way up, and a task's rows on the way down.

Nulls count as empty texts; a null doc_id loses against any other. Of rows that agree in everything one stays.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.session import read_table, save_table, write_table

#: The characters whose deletion makes texts comparable.
IGNORED = " \t\n\x0b\x0c\r"
#: Slices of the digest range, as bits of the leading 64: what one task merges.
SLICE_BITS = 16


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(whole, IGNORED, "").cast("binary"), 256)).alias("digest"),
        F.length(whole).cast("long").alias("n_chars"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def merged(runs: DataFrame, shift: int) -> DataFrame:
    """Merge the runs whose numbers agree after dropping ``shift`` binary digits."""
    group = F.shiftright("run", shift)
    dealt = runs.withColumn("run", group).repartition("slice", "run").sortWithinPartitions("slice", "run", "lead", "digest")
    return dealt.groupBy("slice", "run", "lead", "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; the row with the most code points, then the
    smallest doc_id stays.
    """
    spark = docs.sparkSession
    bits = max(1, fan_in.bit_length() - 1)
    rows = write_table(spark, digests(docs, doc_id, text), "digests")
    lead = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")  # 60 bits: never negative
    own = rows.select("run", "digest", lead.alias("lead"), F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("order"), F.bitwise_not("row").alias("row_order"), F.col("doc_id"), F.col("row")).alias("best"))
    own = own.withColumn("slice", F.shiftright("lead", 60 - SLICE_BITS).cast("int"))
    level = own.groupBy("slice", "run", "lead", "digest").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    first = save_table(spark, level, "runs")
    leaves = read_table(spark, first, level)
    many = leaves.agg(F.max("run")).first()[0] or 0
    top = leaves
    while many:
        top = merged(top, bits)
        many >>= bits
        if many:
            top = write_table(spark, top, "runs")
    won = top.select("lead", "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    down = leaves.select("lead", "digest", "run").join(won, ["lead", "digest"])
    out = rows.join(down.drop("lead"), ["digest", "run"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay. Of rows equal in doc_id and text one stays."""
    spark = docs.sparkSession
    kept = exact_dedup(docs, doc_id, text)
    kept = kept.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    kept = write_table(spark, kept, "kept")
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    marked = docs.withColumns({"__id": docs[doc_id].cast("long"), "__sha": F.sha2(F.translate(whole, IGNORED, "").cast("binary"), 256), "__n": -F.length(whole)})
    out = marked.join(kept, (F.col("__sha") == F.col("__kept_sha")) & F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi")
    ids = docs.select(docs[doc_id].cast("long").alias("__id"))
    if ids.groupBy("__id").count().filter("count > 1").limit(1).count():  # rows of one doc_id: the longest stays
        order = Window.partitionBy("__id", "__sha").orderBy("__n")
        out = out.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    return out.drop("__id", "__sha", "__n")
