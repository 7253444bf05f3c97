"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words padded), by rank, counted over all
training texts. A document's own list is compared to each by the out-of-place distance: the sum of rank differences,
a missing n-gram counting as the list's length. The nearest profile wins.

Letters are lower-cased and mapped to 63 classes, a to z one each and all others by a fixed rule on the code point, so
that n-grams are small numbers and the profiles have a fixed size for each language.

A text that is null or has no letter gets ``und`` and score 0; so does every text if nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import ngrams, textscan
from vecspark.session import ship

LENGTH = 300
BITS = 19
#: Text bytes counted at once; each count costs a pass over all codes for each language.
PROFILED = 1 << 19
CODES = (1 << 18) + (1 << 12) + (1 << 6)
_class: list[np.ndarray] = []


def classes() -> np.ndarray:
    """By code point of a lower-case letter: 1 to 26 for a to z, 27 to 63 for all others; 0 for 0."""
    if not _class:
        points = np.arange(ngrams.ALL, dtype=np.uint64)
        table = (27 + (points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(37)).astype(np.uint32)
        table[97:123] = np.arange(1, 27)
        table[0] = 0
        _class.append(table)
    return _class[0]


def codes(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a letter stream as numbers, and the place where each begins; none spans a word's border inside."""
    c = classes()[stream]
    one = np.flatnonzero(c)
    two = np.flatnonzero((c[:-1] != 0) | (c[1:] != 0))
    three = np.flatnonzero(c[1:-1] != 0) if len(c) > 2 else np.zeros(0, np.int64)
    return (
        np.concatenate([(1 << 18) + (1 << 12) + c[one], (1 << 18) + (c[two] << 6) + c[two + 1], (c[three] << 12) + (c[three + 1] << 6) + c[three + 2]]).astype(np.uint32),
        np.concatenate([one, two, three]),
    )


def profiles(docs: DataFrame, lang: str, text: str, length: int = LENGTH) -> list[tuple[str, np.ndarray]]:
    """(language, its most frequent n-grams in order), counted over every row with a language. Sorted by language.

    Only the lists come to the driver: length numbers for each language.
    """
    ship(docs.sparkSession)
    textscan.limit_batches(docs.sparkSession)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in (part for whole in batches for part in textscan.parts(whole, 0, PROFILED)):
            names = b.column(1).dictionary_encode()
            which = names.indices.to_numpy()
            stream, at, _ = ngrams.letter_stream(b.column(0))
            found, where = codes(stream)
            own = which[ngrams.owners(at, len(stream))][where]
            for k, name in enumerate(names.dictionary.to_pylist()):
                counts[name] = counts.get(name, 0) + np.bincount(found[own == k], minlength=CODES)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "code", "n"])

    picked = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    total = picked.mapInArrow(textscan.lean(run), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in sorted(total.withColumn("place", place).filter(F.col("place") <= length).collect(), key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return [(name, np.array(listed)) for name, listed in out.items()]


def predictor(learned: list[tuple[str, np.ndarray]], length: int = LENGTH):
    """A function of texts that gives the nearest language (or und), the score and the number of letters of each."""
    names = [name for name, _ in learned]
    ranks = np.full((len(names), CODES), length, np.int32)
    for k, (_, listed) in enumerate(learned):
        ranks[k, listed] = np.arange(len(listed))

    def nearest(texts):
        stream, at, n = ngrams.letter_stream(texts)
        found, where = codes(stream)
        owner = ngrams.owners(at, len(stream))[where]
        both = owner.astype(np.uint32) << np.uint32(BITS) | found if len(n) < 1 << 13 else owner << BITS | found
        both.sort()
        both, count = ngrams.runs(both)
        doc, code = (both >> BITS).astype(np.int64), (both & ((1 << BITS) - 1)).astype(np.int64)
        order = np.lexsort((-count, doc))  # stable: of equal counts the smaller code first
        doc, code = doc[order], code[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(n)))[doc]
        top = rank < length
        doc, code, rank = doc[top], code[top], rank[top]
        far = np.array([np.bincount(doc, np.where(r[code] < length, np.abs(r[code] - rank), length), minlength=len(n)) for r in ranks]).reshape(len(names), len(n))
        known = (n > 0) & bool(names)
        best = far.argmin(axis=0) if names else np.zeros(len(n), int)
        least = far.min(axis=0) if names else np.zeros(len(n))
        score = np.where(known, 1 - least / np.maximum(1, np.bincount(doc, minlength=len(n)) * length), 0.0).clip(0, 1)
        return [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], score, n

    return nearest


def judged(batches: Iterable[pa.RecordBatch], at: int, nearest) -> Iterator[tuple]:
    """Each batch in parts, each with what nearest says of the texts in column at: it takes some 130 bytes for each of a text."""
    for whole in batches:
        for part in textscan.parts(whole, at):
            yield part, *nearest(part.column(at).cast(pa.string()))


def predict(docs: DataFrame, learned: list[tuple[str, np.ndarray]], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, lang_pred, score, n_letters for each row; score is 1 minus the distance's share of the largest possible."""
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    sent = spark.sparkContext.broadcast(learned)  # length numbers for each language

    def run(batches):
        nearest = predictor(sent.value, length)
        for b, names, score, n in judged(batches, 1, nearest):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(n)], ["doc_id", "lang_pred", "score", "n_letters"])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(textscan.lean(run), "doc_id long, lang_pred string, score double, n_letters long")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.05) -> DataFrame:
    """docs, all columns, without the rows whose language is und or whose score is under ``least``."""
    learned = profiles(docs.filter(~held_out(docs[doc_id])), lang, text)
    sent, at = docs.sparkSession.sparkContext.broadcast(learned), docs.columns.index(text)

    def run(batches):
        nearest = predictor(sent.value)
        for b, names, score, _ in judged(batches, at, nearest):
            yield b.filter(pa.array((np.array(names, object) != "und") & (score >= least), pa.bool_()))

    return docs.mapInArrow(textscan.lean(run), docs.schema)


def held_out(column) -> F.Column:
    return F.crc32(column.cast("long").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    learned = profiles(docs.filter(~held_out(docs[doc_id])), lang, text)
    found = predict(docs, learned, doc_id, text)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_letters")
