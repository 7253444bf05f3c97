"""Packing documents into sequences of bounded length by linear grouping.

Every document becomes token ids plus an end id and, only if longer than a sequence, is cut into pieces. The plan is
made from the histogram of piece lengths, which has at most ``capacity`` entries whatever the input:

1. Large lengths (over ``small``) are sorted and dealt into groups of equal cardinality, as far as whole lengths allow;
   each counts as its group's largest length.
2. With so few sizes, the configurations (multisets of sizes that fit one sequence) are optimised: a linear program,
   solved by column generation (the dual prices new configurations as a knapsack), rounded down.
3. Actual lengths take the places of the rounded ones, largest first.
4. Large lengths left over and all small ones are best-fitted in decreasing order into what is free.

A placement is a range: pieces a..b of one length, counted in a fixed order, go to consecutive sequences at one offset.
So the plan's size depends on the number of lengths and not on the number of documents, and looking up a piece's place
needs only its rank among pieces of its length: its rank in its partition plus those in partitions before.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import textscan
from vecspark.llm.bpe import LibraryEncoder, Memory, chunks_of, send_vocabulary, together
from vecspark.session import ship, write_table

END_ID, CAPACITY = 1, 4096
#: Text bytes that are encoded together: one batch, or its half for texts of several MB; the model takes each word alone, so more would save nothing.
TOGETHER = 1 << 19


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, run int, own_rank long"


def pieces(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every whole text (null: empty): place in the document, length, checksum, and rank in the task."""
    ship(docs.sparkSession)
    textscan.limit_batches(docs.sparkSession)
    name = send_vocabulary(docs, file)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        store, task, seen = Memory(name, encoder=LibraryEncoder), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in together(batches, size=TOGETHER):
            raw, starts, ends, hashes, first = chunks_of(batch.column(1))
            ids, before = store.joined(store.look_up(raw, starts, ends, hashes))
            ids, cuts = ids.astype("<u4"), before[first]
            n = np.diff(cuts) + 1
            each = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), each)
            piece = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            last = piece == each[row] - 1
            a = cuts[row] + start
            crc = [zlib.crc32(end, zlib.crc32(ids[x : y - 1])) if z else zlib.crc32(ids[x:y]) for x, y, z in zip(a.tolist(), (a + length).tolist(), last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            fresh = np.flatnonzero(np.diff(by, prepend=-1))
            rank = np.empty(len(by), np.int64)
            rank[order] = np.arange(len(by)) - np.repeat(fresh, np.diff(fresh, append=len(by))) + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "run", "own_rank"],
            )

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(textscan.lean(run), PIECES)


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int, most: int) -> tuple[float, list[int]]:
    """The multiset of sizes, at most ``most`` of them and within capacity, of the highest value."""
    best = np.zeros((most + 1, capacity + 1))
    took = np.full((most + 1, capacity + 1), -1)
    for k in range(1, most + 1):
        best[k] = best[k - 1]
        for g, size in enumerate(sizes):
            if values[g] > 1e-12:
                trial = best[k - 1, : capacity + 1 - size] + values[g]
                better = trial > best[k, size:] + 1e-12
                best[k, size:][better] = trial[better]
                took[k, size:][better] = g
    out, c = [0] * len(sizes), capacity
    for k in range(most, 0, -1):
        if (g := int(took[k, c])) >= 0:
            out[g] += 1
            c -= sizes[g]
    return float(best[most, capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, small: int) -> list[tuple[list[int], int]]:
    """Configurations of sizes and how often each is used: the linear program's solution, rounded down."""
    k, most = len(sizes), max(1, capacity // (small + 1))
    if not k:
        return []
    basis = [[min(capacity // s, most) if i == g else 0 for i in range(k)] for g, s in enumerate(sizes)]
    inverse = np.diag([1 / basis[g][g] for g in range(k)])
    use = inverse @ (np.array(demand) + np.arange(1, k + 1) * (1e-7 / k))  # unlike shares: no step is of length 0, so no basis comes twice
    while True:
        value, column = best_configuration(sizes, inverse.sum(axis=0), capacity, most)
        if value <= 1 + 1e-7:
            break
        change = inverse @ np.array(column, float)
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        use = use - step * change
        use[leave] = step
        inverse[leave] /= change[leave]
        for i in range(k):
            if i != leave:
                inverse[i] -= change[i] * inverse[leave]
        basis[leave] = column
    out = []
    left = np.array(demand)
    for x, column in sorted(zip(use.tolist(), basis, strict=True), key=lambda p: -p[0]):
        column = np.array(column)
        n = min([math.floor(x + 1e-6), *(left[g] // column[g] for g in np.flatnonzero(column))])
        if n > 0:
            out.append((column.tolist(), int(n)))
            left -= n * column
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 32, small: int | None = None) -> np.ndarray:
    """Placements, one a row: length, first rank, number of pieces, first sequence, offset. Ordered by length, rank."""
    small = capacity // 8 if small is None else small
    left = {n: c for n, c in histogram.items() if c}
    taken = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = {}  # by free tokens: ranges of sequences
    spaces: list[int] = []

    def open_range(space: int, start: int, n: int) -> None:
        if space not in free:
            free[space] = []
            insort(spaces, space)
        free[space].append((start, n))

    def put(length: int, start: int, n: int, space: int) -> None:
        placed.append((length, taken[length], n, start, capacity - space))
        taken[length] += n
        left[length] -= n

    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    members: list[list[int]] = []
    if total:
        each, held = -(-total // groups), 0
        for n in large:
            if not members or held + left[n] > each:  # a length stays whole; a frequent one is a group of its own
                members.append([])
                held = 0
            members[-1].append(n)
            held += left[n]
    sizes, demand = [m[0] for m in members], [sum(left[n] for n in m) for m in members]
    for column, times in configurations(sizes, demand, capacity, small):
        ranges = [(sequences, times, capacity)]
        sequences += times
        for g in (g for g, k in enumerate(column) for _ in range(k)):
            after = []
            for start, n, space in ranges:
                while n:
                    length = next(x for x in members[g] if left[x])
                    m = min(n, left[length])
                    put(length, start, m, space)
                    after.append((start, m, space - length))
                    start, n = start + m, n - m
            ranges = after
        for start, n, space in ranges:
            open_range(space, start, n)
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fresh = -(-left[length] // (capacity // length))
                open_range(capacity, sequences, fresh)
                sequences += fresh
                continue
            space = spaces[at]
            start, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            m = min(n, left[length])
            if m < n:
                open_range(space, start + m, n - m)
            put(length, start, m, space)
            open_range(space - length, start, m)
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id alone. Repeated rows are packed each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = write_table(spark, pieces(docs, file, doc_id, text, capacity, end_id), "pieces")
    counts = cut.groupBy("run", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    table = plan(histogram, capacity)
    sent = spark.sparkContext.broadcast(table)
    before = counts.select("run", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("run")) - F.col("n")).alias("before"))

    def run(batches):
        at = sent.value
        step = np.int64(1) << np.int64(40)
        keys = at[:, 0] * step + at[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(keys, length * step + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[k, 3] + rank - at[k, 1]), pa.array(at[k, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(before, ["run", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own_rank")).alias("rank"))
    return ranked.mapInArrow(textscan.lean(run), PACKED)
