"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are whether a hashed n-gram (4, 6 or 8 characters of a padded word) occurs in the text. Each is scaled by the log of
the ratio of its smoothed shares among toxic and other training texts; a logistic scorer is fitted on the scaled ones.
Training takes a bounded sample: the ``per_class`` labelled rows of each class with the smallest hash of their doc_id,
texts of any length (each has at most 2^20 features); the intercept is set back to the classes' shares among all labels.

Scoring covers every whole text; null and empty texts get the intercept alone (no feature occurs). Without labels of
both classes every score is the share of toxic labels, or 0 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import linear, ngrams, textscan
from vecspark.llm.langid import held_out
from vecspark.session import ship

BITS = 20
SIZES = (4, 6, 8)
#: Features in fewer training texts, or whose log ratio is nearer to 0, are left out.
LEAST_TEXTS, LEAST_RATIO = 5, 1.2
PER_CLASS = 2500
THRESHOLD = 0.3


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, ascending, and their number before each text."""
    stream, at, n = ngrams.letter_stream(texts)
    owner = ngrams.owners(at, len(stream)).astype(np.uint64)
    letter = stream != 0
    found = []
    for size in SIZES:
        if len(stream) < size:
            continue
        m = len(stream) - size + 1
        h = np.full(m, size, np.uint32)
        inside = np.ones(m, bool)
        for j in range(size):
            h = (h ^ stream[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if 0 < j < size - 1:
                inside &= letter[j : j + m]
        where = np.flatnonzero(inside)
        found.append(owner[where] << np.uint64(BITS) | (h[where] >> np.uint32(32 - BITS)).astype(np.uint64))
    both = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if len(n) <= 1 << (32 - BITS):
        both = both.astype(np.uint32)
    both.sort()
    both, _ = ngrams.runs(both)
    return (both & type(both[0])((1 << BITS) - 1) if len(both) else both).astype(np.int64), np.searchsorted(both >> BITS if len(both) else both, np.arange(len(n) + 1))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """A weight for each feature and the intercept."""
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    one = labels.filter(labels[doc_id].isNotNull() & labels[label].isNotNull() & ~held_out(labels[doc_id]))
    one = one.groupBy(labels[doc_id].cast("long").alias("label_id")).agg(F.max(labels[label].cast("int")).alias("label"))
    counts = dict(one.groupBy("label").count().collect())
    n, k = sum(counts.values()), sum(v for key, v in counts.items() if key == 1)
    zero = np.zeros(1 << BITS, np.float32)
    share = np.clip(k / n, 1e-6, 1 - 1e-6) if n else 1e-6
    prior = float(np.log(share / (1 - share)))
    if not 0 < k < n:
        return zero, prior if n else -40.0
    order = (F.xxhash64("label_id"), "label_id")
    picked = [r for y in (1, 0) for r in one.filter(F.col("label") == y).orderBy(*order).limit(per_class).collect()]
    sample = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in picked], "label_id long, label int"))
    rows = docs.filter(docs[text].isNotNull()).join(sample, docs[doc_id].cast("long") == sample["label_id"])

    def run(batches):
        for b in batches:
            columns, cuts = features(b.column(0))
            raw, at = columns.astype("<u4").tobytes(), (cuts * 4).tolist()
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["label_id", "label", "features"])

    texts = rows.select(docs[text].cast("string").alias("text"), "label_id", "label")
    texts = texts.groupBy("label_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label_id", "label")  # of an id's texts one: at most 2 * per_class rows
    table = texts.mapInArrow(textscan.lean(run), "label_id long, label int, features binary").toArrow()
    own = sorted(zip(table["label_id"].to_pylist(), table["label"].to_pylist(), table["features"].to_pylist(), strict=True))
    y = np.array([r[1] for r in own], float)
    if not 0 < y.sum() < len(y):
        return zero, prior
    cuts = np.concatenate([[0], np.cumsum([len(r[2]) // 4 for r in own])]).astype(np.int64)
    columns = np.frombuffer(b"".join(r[2] for r in own), "<u4").astype(np.int64)
    of_class = np.repeat(y > 0, np.diff(cuts))
    p, q = (np.bincount(columns[of_class == c], minlength=1 << BITS) + 1.0 for c in (True, False))
    ratio = np.log(p / y.sum()) - np.log(q / (len(y) - y.sum()))
    ratio[(p + q < LEAST_TEXTS + 2) | (np.abs(ratio) < LEAST_RATIO)] = 0
    told = ratio[columns] != 0
    cuts = np.concatenate([[0], np.cumsum(told)])[cuts]
    columns = columns[told]
    weights, intercept = linear.fit(columns, ratio[columns], cuts, y, 1 << BITS, np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), penalty=5e-4)
    return (weights * ratio).astype(np.float32), intercept + prior


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches):
        weights, intercept = sent.value
        for b in batches:
            columns, cuts = features(b.column(1))
            total = np.concatenate([[0], np.cumsum(weights[columns], dtype=np.float64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(linear.sigmoid(np.diff(total[cuts]) + intercept))], ["doc_id", "score"])

    found = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(textscan.lean(run), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from the labels that are not held out, score all rows."""
    return score(docs, learn(docs, labels, doc_id, text, label), doc_id, text)
