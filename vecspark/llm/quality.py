"""Quality classifier: a weak-label model of overlapping heuristic labellers, and a hashed linear scorer.

1. Each labeller votes bad, good or nothing on every whole text, from counts over its bytes and words (capitals,
   exclamation marks, symbols, repeated words, repeated lines, few distinct words, word length, digits).
2. Expectation-maximisation estimates the shares of good texts and of several kinds of bad ones, one for each
   labeller, and how each labeller votes on each kind, taking labellers as independent within a kind. Two bounds keep
   the kinds what they are: on good texts no labeller votes bad more often than LOOSE, on its own kind at least FIRM.
   This needs only how often each combination of votes occurs, counted over all rows (at most 3 ** 8 combinations).
3. The posteriors label a bounded sample of rows (the ``sample`` smallest hashes of doc_id), on which a logistic scorer
   is fitted whose features are hashed: shares of byte-class trigrams and ranges of the counts.

Every row is then scored by the scorer. Texts that are null or without a word get quality 0. With fewer than two rows
or without any bad (or good) posterior the posterior itself is the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import linear, textscan
from vecspark.session import ship

BITS, SAMPLE = 14, 6000
BAD, GOOD = 1, 2
LOOSE, FIRM = 0.01, 0.98
#: With fewer words no labeller votes bad; the combination of a text without words.
FEW, NOTHING = 10, -1
#: Name, and from which value on it votes bad, up to which value good.
LABELLERS = (("capitals", 0.35, 0.1), ("exclamations", 0.2, 0.02), ("symbols", 0.12, 0.02), ("repeated words", 0.15, 0.04), ("distinct words missing", 0.65, 0.45), ("repeated lines", 0.6, 0.34), ("word length", 15.0, 8.0), ("digits", 0.5, 0.2))
_LETTER = textscan.byte_table([*range(65, 91), *range(97, 123), *range(0x80, 0x100)])
_UPPER, _DIGIT, _BANG = textscan.byte_table(range(65, 91)), textscan.byte_table(range(48, 58)), textscan.byte_table(b"!")
_SYMBOL = textscan.byte_table(b"|%#&*@$^~<>{}[]=_+\\/`")
#: Classes of bytes for trigrams: capitals, other letters, digits, white space, sentence marks, !, symbols, beyond ASCII.
_CLASS = np.full(256, 4, np.int64)
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), textscan.SPACES)):
    _CLASS[list(_members)] = _k
_CLASS[33] = 5
_CLASS[np.flatnonzero(_SYMBOL)] = 6
_CLASS[128:] = 7


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[at])


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of distinct values of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(first) - 1)


def measures(texts) -> tuple[np.ndarray, np.ndarray]:
    """One row of values for each text, in the order of LABELLERS, and its number of words."""
    data, at = textscan.buffers(texts)
    starts, ends, first = textscan.spans(data, at, textscan.NOT_SPACE)
    words = textscan.word_hashes(data, starts, ends)
    n = np.diff(first)
    some = np.maximum(n, 1)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][n > 0]] = False
    line_starts, line_ends, line_first = textscan.spans(data, at, ~textscan.byte_table(b"\n\r"))
    lines = np.diff(line_first)
    line_kinds = _distinct(textscan.word_hashes(data, line_starts, line_ends), line_first)
    letters = np.maximum(_per_text(_LETTER[data], at), 1)
    size = np.maximum(np.diff(at), 1)
    kinds = _distinct(words, first)
    out = np.stack([
        _per_text(_UPPER[data], at) / letters,
        _per_text(_BANG[data], at) / some,
        _per_text(_SYMBOL[data], at) / some,
        _per_text(again, first) / some,
        np.where(n >= 20, 1 - kinds / np.minimum(some, 20 * np.sqrt(some)), 0.5),
        np.where(lines >= 4, 1 - line_kinds / np.maximum(lines, 1), 0.0),
        _per_text(textscan.NOT_SPACE[data] & ((data & 0xC0) != 0x80), at) / some,
        _per_text(_DIGIT[data], at) / size,
    ], axis=1)
    return out, n


def votes(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A combination of votes as one number, base 3; NOTHING without words."""
    out = np.zeros(len(values), np.int64)
    for k, (_, bad, good) in enumerate(LABELLERS):
        out = out * 3 + np.where(values[:, k] >= bad, BAD * (n >= FEW), np.where(values[:, k] <= good, GOOD, 0))
    return np.where(n > 0, out, NOTHING)


def spread(combinations: np.ndarray) -> np.ndarray:
    return np.stack([combinations // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1)


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The probability of being good for each combination of votes."""
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] * (k != NOTHING) for k in keys.tolist()], float)
    cast = spread(np.maximum(keys, 0))
    hot = np.stack([cast == v for v in range(3)], axis=2).astype(float)
    m = len(LABELLERS)
    tables = np.tile([0.3, 0.05, 0.65], (m + 1, m, 1))  # the last class is good, class k the bad texts that labeller k marks
    tables[np.arange(m), np.arange(m)] = [0.05, 0.9, 0.05]
    tables[m] = [0.2, LOOSE / 2, 0.8 - LOOSE / 2]
    shares = np.append(np.full(m, 0.2 / m), 0.8)
    for _ in range(rounds):
        fit = np.log(shares) + np.einsum("ikv,ckv->ic", hot, np.log(tables))
        fit = np.exp(fit - fit.max(axis=1, keepdims=True))
        fit /= fit.sum(axis=1, keepdims=True)
        w = n[:, None] * fit
        shares = (w.sum(axis=0) + 1e-3) / (w.sum() + 1e-3 * (m + 1))
        tables = (np.einsum("ic,ikv->ckv", w, hot) + 0.5) / (w.sum(axis=0) + 1.5)[:, None, None]
        for c, k, low, high in [(k, k, FIRM, 1.0) for k in range(m)] + [(m, k, 0.0, LOOSE) for k in range(m)]:
            held = min(max(tables[c, k, BAD], low), high)
            rest = tables[c, k, [0, GOOD]]
            tables[c, k, [0, GOOD]] = rest / rest.sum() * (1 - held)
            tables[c, k, BAD] = held
    p = 1 - fit[:, m]
    return dict(zip(keys.tolist(), np.where(keys == NOTHING, 0.0, 1 - p).tolist(), strict=True))


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: columns, values, number before each text; and the combinations of votes."""
    data, at = textscan.buffers(texts)
    n = len(at) - 1
    values, words = measures(texts)
    kind = _CLASS[data]
    tri = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))[: len(tri)]
    inside = np.arange(len(tri)) + 3 <= at[1:][owner] if len(tri) else np.zeros(0, bool)
    grid = np.bincount(owner[inside] * 512 + tri[inside], minlength=n * 512).reshape(n, 512)
    row, column = np.nonzero(grid)
    part = np.sqrt(grid[row, column] / np.maximum(grid.sum(axis=1), 1)[row])
    level = np.floor(np.log2(np.maximum(values, 0) + 2**-10) * 2).astype(np.int64) + 64
    names = np.arange(len(LABELLERS))[None] * 256 + level + (1 << 12)
    row = np.concatenate([row, np.repeat(np.arange(n), len(LABELLERS))])
    column = np.concatenate([column, names.reshape(-1)])
    part = np.concatenate([part, np.ones(names.size)])
    order = np.argsort(row, kind="stable")
    hashed = (textscan.mix(column[order].astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
    return hashed, part[order], np.searchsorted(row[order], np.arange(n + 1)), votes(values, words)


Model = tuple[dict[int, float], np.ndarray | None, float]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Posteriors by combination of votes, the scorer's weights (none: posteriors alone) and its intercept."""
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)

    def count(batches):
        total: dict[int, int] = {}
        for b in batches:
            keys, n = np.unique(votes(*measures(b.column(0))), return_counts=True)
            for k, x in zip(keys.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + x
        yield pa.RecordBatch.from_pydict({"votes": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    texts = docs.select(docs[text].cast("string").alias("text"))
    counts = dict(texts.mapInArrow(textscan.lean(count), "votes long, n long").groupBy("votes").agg(F.sum("n")).collect())
    posterior = posteriors(counts)
    ids = docs.select(docs[doc_id].cast("long").alias("sample_id")).orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample)
    picked = F.broadcast(spark.createDataFrame([(x,) for x in {r[0] for r in ids.collect()}], "sample_id long"))
    rows = docs.select(docs[doc_id].cast("long").alias("sample_id"), docs[text].cast("string").alias("text")).join(picked, "sample_id")
    rows = rows.groupBy("sample_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of an id's texts one, so at most sample rows

    def extract(batches):
        for b in batches:
            columns, values, cuts, cast = features(b.column(1))
            packed = [np.stack([columns[x:y].astype("<f4"), values[x:y].astype("<f4")]).tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cast), pa.array(packed, pa.binary())], ["sample_id", "votes", "features"])

    own = sorted(tuple(r.values()) for r in rows.select("sample_id", "text").mapInArrow(textscan.lean(extract), "sample_id long, votes long, features binary").toArrow().to_pylist())
    y = np.array([posterior[v] for _, v, _ in own])
    if len(y) < 2 or y.max() < 0.5 or y.min() > 0.5:
        return posterior, None, 0.0
    grids = [np.frombuffer(f, "<f4").reshape(2, -1) for _, _, f in own]
    cuts = np.concatenate([[0], np.cumsum([g.shape[1] for g in grids])])
    both = np.concatenate(grids, axis=1)
    weights, intercept = linear.fit(both[0].astype(np.int64), both[1], cuts, y, 1 << BITS, steps=200)
    return posterior, weights, intercept


def scorer(model: Model):
    """A function of texts that gives the quality and the posterior of each."""
    posterior, weights, intercept = model

    def rate(texts):
        columns, values, cuts, cast = features(texts)
        own = np.array([posterior.get(v, 0.0) for v in cast.tolist()], float)
        if weights is None:
            return own, own
        total = np.concatenate([[0], np.cumsum(weights[columns].astype(float) * values)])
        return np.where(cast == NOTHING, own, linear.sigmoid(np.diff(total[cuts]) + intercept)), own

    return rate


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, quality (0 to 1), posterior (0 to 1) and good for each row."""
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        rate = scorer(sent.value)
        for b in batches:
            quality, own = rate(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(quality), pa.array(own), pa.array(quality >= 0.5)], ["doc_id", "quality", "posterior", "good"])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(textscan.lean(run), "doc_id long, quality double, posterior double, good boolean")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose quality is under ``least``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(learn(docs, doc_id, text)), docs.columns.index(text)

    def run(batches):
        rate = scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(rate(b.column(at).cast(pa.string()))[0] >= least, pa.bool_()))

    return docs.mapInArrow(textscan.lean(run), docs.schema)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Learn from docs alone and score every row."""
    return score(docs, learn(docs, doc_id, text, sample), doc_id, text)
