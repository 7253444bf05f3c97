"""Vectorised scanning of UTF-8 text: word spans, word hashes and shingle hashes over whole Arrow batches.

Everything works on the byte buffers of an Arrow string array with numpy, so no Python code runs per word.
Nulls count as empty texts. Memory is bounded by the batch, which :func:`limit_batches` bounds by bytes; a single
text longer than that forms a batch of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: ASCII white space: space and \\t to \\r.
SPACES = bytes([32, *range(9, 14)])
#: Bytes and rows of an Arrow batch that Spark hands to Python.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096
#: Text bytes of a part of a batch, for work that takes some hundred bytes for each byte of text.
PART_BYTES = 1 << 18
#: Bytes hashed at once; the powers of the hash's base are kept for so many positions.
BLOCK = 1 << 17

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that powers can be inverted modulo 2**64
_U64 = np.uint64


def limit_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _trim() -> None:
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function for mapInArrow that gives freed memory back when its task begins and ends: workers live on between tasks."""

    def trimmed(batches):
        _trim()
        yield from run(batches)
        _trim()

    return trimmed


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of the column's texts each; a longer text is a slice of its own."""
    _, at = buffers(batch.column(column).cast(pa.string()))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def byte_table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = ~byte_table(SPACES)
#: Letters, digits and everything beyond ASCII.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)])


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at.astype(np.int64) - at[0]


def spans(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, none across texts, and the number of runs before each text."""
    return spans_inside(member[data], at)


def spans_inside(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, from a mark for each byte."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.empty(len(inside), bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    cut = at[(at > 0) & (at < len(inside))]
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge)
    edge[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=edge[:-1])
    edge[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U64(32))
    h *= _U64(_STEP)
    h ^= h >> _U64(29)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[0] = 1
    return np.cumprod(out, dtype=_U64)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=_U64) * _U64(_STEP)) | _U64(1)
    if len(_tables.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables["bytes"], _tables["up"], _tables["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z as a-z if lower): a polynomial modulo 2**64, then mixed."""
    out = np.empty(len(starts), _U64)
    k = 0
    while k < len(starts):
        a = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
        b = ends[m - 1]
        table, up, down = _power_tables(int(b - a) + 1)
        block = LOWER[data[a:b]] if lower else data[a:b]
        total = np.empty(b - a + 1, _U64)
        total[0] = 0
        np.cumsum(table[block] * up[: b - a], out=total[1:], dtype=_U64)
        s, e = starts[k:m] - a, ends[k:m] - a
        out[k:m] = (total[e] - total[s]) * down[s]
        k = m
    return mix(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, and the number of shingles before each text.

    words: word hashes of all texts; first: the number of words before each text. A text of 1 to k - 1 words has one
    shingle, all its words; a text without words has none.
    """
    n = np.diff(first)
    each = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    if not len(words):
        return np.zeros(0, _U64), at
    base = _powers(_STEP, k + 1)
    padded = np.concatenate([words, np.zeros(k, _U64)])
    start = np.repeat(first[:-1] - at[:-1], each) + np.arange(at[-1])
    short = np.flatnonzero((n > 0) & (n < k))
    out = np.zeros(at[-1], _U64)
    for j in range(k):
        part = padded[start + j] * base[j]
        if len(short):
            part[at[:-1][short[n[short] <= j]]] = 0
        out += part
    if len(short):
        out[at[:-1][short]] += n[short].astype(_U64) * base[k]
    return mix(out), at
