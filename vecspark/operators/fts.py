"""Full-text search: postings, statistics and BM25 ranking as DataFrames.

Only the postings of the query's terms are scored; documents without any term count in N and in the average length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.analyzers import ANALYZERS, Analyzer
from vecspark.session import spread

K1, B = 1.5, 0.75


def occurrences(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


class FtsIndex:
    """Documents (id, text) under an analyzer. Nulls are no documents; of an id that occurs twice, use upsert first."""

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str | Analyzer = "simple"):
        self.analyze = ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer
        self.documents = spread(documents.filter(documents[id_col].isNotNull() & documents[text_col].isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content")))
        self.terms = self.documents.select("doc_id", self.analyze(F.col("content")).alias("terms"))

    def add(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FtsIndex:
        """With these documents too; ids replace."""
        new = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))
        return FtsIndex(self.documents.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new), "doc_id", "content", self.analyze)

    def remove(self, ids) -> FtsIndex:
        return FtsIndex(self.documents.filter(~F.col("doc_id").isin(list(ids))), "doc_id", "content", self.analyze)

    def tokens(self) -> DataFrame:
        """doc_id, pos (from 0), term."""
        return self.terms.select("doc_id", F.posexplode_outer("terms").alias("pos", "term")).filter("pos is not null")

    def postings(self) -> DataFrame:
        """doc_id, term, tf."""
        each = self.terms.select("doc_id", F.explode_outer("terms").alias("term"))  # explode would analyze twice, once for a filter
        return each.filter("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))

    def document_frequencies(self) -> DataFrame:
        """term, df."""
        each = self.terms.select(F.explode_outer(F.array_distinct("terms")).alias("term"))
        return each.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))

    def lengths(self) -> DataFrame:
        """doc_id, length in terms."""
        return self.terms.select("doc_id", F.size("terms").cast("long").alias("length"))

    def statistics(self) -> DataFrame:
        """One row: n documents, total_terms, avgdl."""
        return self.lengths().agg(F.count("*").alias("n"), F.sum("length").alias("total_terms"), F.avg("length").alias("avgdl"))

    def query_terms(self, query: str) -> list[str]:
        spark = self.documents.sparkSession
        return spark.range(1).select(self.analyze(F.lit(query)).alias("t")).first()[0] if query else []

    def scores(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """doc_id, score, content of every document with a term of the query; a repeated term counts each time.

        Two scans, for the statistics and for the scores, and no join: a row's counts of the query's terms are looked up
        in its term array. A row's text is analyzed once in each: the generator keeps the optimizer from repeating the
        analysis in every expression and filter above it.
        """
        asked = self.query_terms(query)
        terms = sorted(set(asked))
        counted = F.transform(F.array(self.analyze(F.col("content"))), lambda t: F.struct(F.size(t).alias("length"), *[occurrences(t, w).alias(f"tf_{i}") for i, w in enumerate(terms)]))
        own = self.documents.select("doc_id", "content", F.inline_outer(counted))
        if not terms:
            return own.select("doc_id", F.lit(0.0).alias("score"), "content").limit(0)
        stats = own.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]).first()  # one row
        n, avgdl = stats["n"], stats["avgdl"] or 1.0
        norm = F.lit(k1) * (1.0 - b + b * F.col("length") / F.lit(float(avgdl)))
        total = F.lit(0.0)
        for i, w in enumerate(terms):
            df = stats[f"df_{i}"] or 0
            idf = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
            total = total + F.lit(idf * asked.count(w)) * (F.col(f"tf_{i}") * (k1 + 1.0)) / (F.col(f"tf_{i}") + norm)
        found = own.select("doc_id", total.alias("score"), "content")
        return found.filter(F.col("score") > 0)

    def search(self, query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """The k best, highest score first, ties by doc_id."""
        return self.scores(query, k1, b).orderBy(F.desc("score"), "doc_id").limit(max(k, 0))
