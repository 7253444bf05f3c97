"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Every text's set of word shingles (64-bit hashes) is sketched in one pass: the hash range is cut into bins, each bin
   keeps its smallest hash, and an empty bin borrows from the first full one in a fixed random order of the bin.
   Bands of bins are hashed to bucket keys. Equal sets are one node from here on.
2. In each bucket of two or more nodes, the smallest node is the hub and an edge goes to each other node (a star), so
   edges grow with the bucket and not with its square. Edges are confirmed on the full sets.
3. What a star leaves open is settled in further rounds: nodes of a bucket that are not yet in one component get
   GROWTH times as many hubs in each round, and hubs that had their turn leave. Nested hub sets make sure that each two nodes
   of a bucket were compared or are connected when the rounds end, which they do after log(bucket size) rounds, to the base GROWTH, at the latest;
   a bucket whose nodes are all connected ends at once. Two nodes are compared in the first bucket they share only, and
   only if an upper bound of what they share reaches the threshold. The bound is exact: a shingle that no other open
   node has is shared with none (heavily edited copies drop out without pairs), and of the others as many differ, at
   least, as bits differ in the two nodes' parities of shingles by hash (WORDS longs). So what a group of copies around
   the threshold makes is about its links between components, not its pairs.
4. Components are found by alternating large-star and small-star steps, as joins; nothing is collected.

Bands are chosen so that a pair at the threshold shares no bucket with a probability of 1e-6 if bins agree independently.
Bins of short texts don't quite: simulated, it is some 1e-6 (none to one in 200,000 pairs of 4/5 to 17/20 shingles).

Null and empty texts have no shingles and are linked with nothing. Repeated rows count each. A row's node is its set,
not its doc_id, so rows that share a doc_id are still compared as different texts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textscan
from vecspark.session import drop_table, read_table, save_table, ship, write_table

U64 = np.uint64
#: Bins in a band; nodes that are broadcast at most (of 16 bytes and a doc_id: a few MB).
ROWS, BROADCAST = 5, 100_000
#: Times the hubs of the round before; longs of 64 parity bits for each node.
GROWTH, WORDS = 32, 8
PARITY = [f"odd{k}" for k in range(WORDS)]


def bands_for(at_least: tuple[int, int], rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (at_least[0] / at_least[1]) ** rows))


def sets(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the number of them before each text."""
    data, at = textscan.buffers(texts)
    starts, ends, first = textscan.spans(data, at, textscan.NOT_SPACE)
    hashes, cuts = textscan.shingle_hashes(textscan.word_hashes(data, starts, ends, lower=True), first, shingle)
    edge = cuts.tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[cuts[:-1][cuts[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[cuts]


@cache
def donors(bins: int) -> np.ndarray:
    """The bins in a random order for each bin, as columns: an empty bin borrows from the first that is full."""
    return np.random.default_rng(20240229).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1).T.copy()


def sketches(hashes: np.ndarray, cuts: np.ndarray, bins: int) -> np.ndarray:
    """One row of bin minima for each set; rows of empty sets mean nothing."""
    n = np.diff(cuts)
    owner = np.repeat(np.arange(len(n)), n)
    cell = owner * bins + ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, full = np.zeros(len(n) * bins, U64), np.zeros(len(n) * bins, bool)
    out[cell[first]], full[cell[first]] = hashes[first], True
    empty = np.flatnonzero(~full.reshape(-1, bins) & (n > 0)[:, None])
    for draw in donors(bins):
        if not len(empty):
            break
        source = empty - empty % bins + draw[empty % bins]
        good = full[source]
        out[empty[good]] = out[source[good]]
        empty = empty[~good]
    return out.reshape(-1, bins)


def band_keys(grid: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.repeat(np.arange(1, bands + 1, dtype=U64)[None], len(grid), 0) * U64(0xA24BAED4963EE407)
    for i in range(rows):
        total = textscan.mix(total + grid[:, i::rows][:, :bands])
    return total


def node_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """16 bytes for each set."""
    out = np.zeros((len(cuts) - 1, 2), U64)
    n = np.diff(cuts)
    full = n > 0
    if len(hashes):
        for j, salt in enumerate((0x632BE59BD9B4E019, 0xE220A8397B1DCDAF)):
            out[full, j] = np.add.reduceat(textscan.mix(hashes ^ U64(salt)), cuts[:-1][full])
    out = textscan.mix(out + n.astype(U64)[:, None])
    return out.astype(">u8").view("S16").reshape(-1)


def fixed(values: np.ndarray) -> pa.Array:
    """16-byte values as an Arrow binary array."""
    raw = values.tobytes()
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, len(raw) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(raw)])


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            hashes, cuts = sets(b.column(1), shingle)
            n = np.diff(cuts)
            keys = band_keys(sketches(hashes, cuts, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), fixed(node_keys(hashes, cuts)), lists], ["doc_id", "text_key", "n", "node", "bands"])

    whole = docs[text].cast("string")
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"))
    return picked.mapInArrow(textscan.lean(run), "doc_id long, text_key long, n long, node binary, bands array<long>")


def parities(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each set, the parity of the number of hashes by their lowest bits, as WORDS longs of 64 bits."""
    n = len(cuts) - 1
    cell = np.repeat(np.arange(n), np.diff(cuts)) * (64 * WORDS) + (hashes & U64(64 * WORDS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * 64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(n, WORDS)


def full_sets(docs: DataFrame, doc_id: str, text: str, shingle: int, needed: DataFrame) -> DataFrame:
    """The sets of the needed nodes (node, doc_id), with their parities: each from the one row of that doc_id that has it."""
    spark = docs.sparkSession
    few = needed.limit(BROADCAST + 1).count() <= BROADCAST
    ids = needed.select(F.col("any_id").alias("doc_id"), F.col("any_key").alias("text_key")).distinct()
    whole = docs[text].cast("string")
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"))
    picked = picked.join(F.broadcast(ids) if few else ids, picked["doc_id"].eqNullSafe(ids["doc_id"]) & (picked["text_key"] == ids["text_key"]), "left_semi")

    def run(batches):
        for b in batches:
            hashes, cuts = sets(b.column(0), shingle)
            raw, at = hashes.astype("<u8").tobytes(), (cuts * 8).tolist()
            odd = parities(hashes, cuts)
            yield pa.RecordBatch.from_arrays([fixed(node_keys(hashes, cuts)), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), *(pa.array(odd[:, k]) for k in range(WORDS))], ["node", "members", *PARITY])

    found = picked.select("text").mapInArrow(textscan.lean(run), "node binary, members binary, " + ", ".join(f"{c} long" for c in PARITY))
    return write_table(spark, found.dropDuplicates(["node"]), "sets")  # repeated rows


def confirmed(pairs: DataFrame, members: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity reaches the threshold."""
    num, den = at_least

    def run(batches):
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = den * shared >= num * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["a", "b"])

    one = members.select(F.col("node").alias("a"), F.col("members").alias("xs"))
    two = members.select(F.col("node").alias("b"), F.col("members").alias("ys"))
    joined = one.join(small(pairs.select("a", "b")), "a").join(two, "b").select("a", "b", "xs", "ys")
    return joined.mapInArrow(textscan.lean(run), "a binary, b binary")


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows (of two nodes: a few MB); else it is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node it is connected with."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    path = save_table(spark, edges, "edges")
    edges = read_table(spark, path, edges)
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        few = edges.limit(BROADCAST + 1).count() <= BROADCAST
        large = both.join(F.broadcast(lows) if few else lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(F.broadcast(low) if few else low, "u")
        after = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        after = after.select("e.u", "e.v").filter("u > v").distinct()
        new = save_table(spark, after, "edges")
        edges = read_table(spark, new, after)
        drop_table(spark, path)
        path = new
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.x", "e.up")
        roles = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if not roles.filter("ups > 1 or (ups > 0 and low = 0)").limit(1).count():  # stars: each edge ends in a root
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def open_keys(live: DataFrame) -> DataFrame:
    """The buckets whose nodes are in more than one component."""
    return live.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")


def shared_sizes(live: DataFrame, members: DataFrame) -> DataFrame:
    """Of the shingles that each live node shares with any other: their number (rest), and their parities."""
    nodes = small(live.select("node").distinct())

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            own = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column(1)]
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            values, first, count = np.unique(np.concatenate(own), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(count, 2).astype(np.int64)), b.column(0).take(pa.array(owner[first]))], ["shingle", "n", "node"])

    own = members.join(nodes, "node", "left_semi")
    met = own.select("node", "members").mapInArrow(textscan.lean(run), "shingle long, n long, node binary")
    once = met.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("node").alias("node")).filter("n = 1")
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    word = F.expr(f"cast(shiftrightunsigned(shingle, 6) & {WORDS - 1} as int)")
    alone = once.groupBy("node").agg(F.count("*").alias("alone"), *(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"x{k}") for k in range(WORDS)))
    return own.select("node", (F.length("members") / 8).cast("long").alias("of"), *PARITY).join(alone, "node", "left").select("node", (F.col("of") - F.coalesce("alone", F.lit(0))).alias("rest"), *(F.col(c).bitwiseXOR(F.coalesce(f"x{k}", F.lit(0).cast("long"))).alias(c) for k, c in enumerate(PARITY)))


def linked(buckets: DataFrame, members: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """(node, comp) of all nodes that have a link; buckets: (key, node, n, before, size), members: (node, members, PARITY).

    before: the keys of the node's bands before this one.
    """
    spark = buckets.sparkSession
    num, den = at_least
    close = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    new_here = ~F.arrays_overlap("before_a", "before_b")
    share = F.conv(F.substring(F.hex("node"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    labels: DataFrame | None = None
    live, turn = buckets.withColumn("share", share), 0
    while True:
        most = GROWTH**turn  # hubs of a bucket, about
        if turn == 0:
            hubs = live.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub")).select("key", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
            own = live.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
            pairs = hubs.join(own, "key").filter((F.col("a") < F.col("b")) & close)
        else:
            hub = F.col("share") < most / F.col("size")
            columns = ["n", "comp", "before", "rest", *PARITY]
            hubs = live.filter(hub).select("key", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
            own = live.select("key", F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns), hub.alias("hub_b"))
            apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in PARITY), F.lit(0))
            both = F.least(F.least("rest_a", "rest_b") * 2, F.col("rest_a") + F.col("rest_b") - apart)  # twice what they share, at most
            pairs = hubs.join(own, "key").filter((F.col("comp_a") != F.col("comp_b")) & close & (~F.col("hub_b") | (F.col("a") < F.col("b"))) & (both * (num + den) >= (F.col("n_a") + F.col("n_b")) * (2 * num)) & new_here)
        pairs = write_table(spark, pairs.select("a", "b").distinct(), "candidates")
        new = write_table(spark, confirmed(pairs, members, at_least), "links")
        if labels is None:
            labels = write_table(spark, components(new), "labels")
        elif new.limit(1).count():
            ends, to = new, small(labels)
            for c in ("a", "b"):
                ends = ends.join(to.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left").withColumn(c, F.coalesce(f"comp_{c}", c)).drop(f"comp_{c}")
            moved = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            moved = small(write_table(spark, moved, "moves"))
            old = labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            fresh = moved.select(F.col("comp").alias("node"), F.col("to").alias("comp"))
            labels = write_table(spark, old.unionByName(fresh).groupBy("node").agg(F.min("comp").alias("comp")), "labels")
        if turn == 0:
            rest = live.join(hubs.select("key", F.col("a").alias("hub")), "key").filter("node != hub").drop("hub")
        else:
            rest = live.filter(F.col("share") >= most / F.col("size")).drop("comp")  # rest and parities stay: bounds as before
        rest = rest.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        live = write_table(spark, rest.join(open_keys(rest), "key", "left_semi"), "live")
        left = live.select("node").distinct().count() if turn == 0 else 0
        while left:
            sizes = small(write_table(spark, shared_sizes(live, members), "shared"))
            rest = live.drop("rest", *PARITY).join(sizes, "node")
            rest = rest.filter(F.col("rest") * den >= F.col("n") * num)
            live = write_table(spark, rest.join(open_keys(rest), "key", "left_semi"), "live")
            before, left = left, live.select("node").distinct().count()
            if left > 0.5 * before:  # fewer open nodes share fewer shingles: again while that drops many
                break
        turn += 1
        if not live.limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, at_least: tuple[int, int] = (80, 100), rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; also text_key, node and comp.

    Texts are linked when the Jaccard similarity of their sets of ``shingle`` consecutive words (A-Z lower-cased, split
    at ASCII white space) is at least ``at_least``, an exact ratio. component_id is the smallest doc_id reachable.
    comp is the component itself: unlinked texts differ in it, even where their doc_id is null or the same.
    """
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    bands = bands_for(at_least, rows)
    signed = write_table(spark, signatures(docs, doc_id, text, shingle, bands, rows), "signatures")
    full = signed.filter("n > 0")
    nodes = full.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("any"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.select("node", F.col("any.doc_id").alias("any_id"), F.col("any.text_key").alias("any_key"), "n", "bands")
    entries = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = write_table(spark, entries.join(shared, "key"), "met")
    names = met.select("node").distinct().withColumn("met", F.lit(True))
    all_bands = nodes.join(small(names), "node").select("node", "bands")
    buckets = met.join(all_bands, "node").withColumn("before", F.expr("slice(bands, 1, array_position(bands, key) - 1)")).drop("bands")
    buckets = write_table(spark, buckets, "buckets")
    ids = full.groupBy("node").agg(F.min("doc_id").alias("low"))
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node")
    if buckets.limit(1).count():
        needed = nodes.select("node", "any_id", "any_key").join(buckets.select("node").distinct(), "node")
        labels = linked(buckets, full_sets(docs, doc_id, text, shingle, needed), at_least)
        ids = ids.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        lows = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
        ids = ids.join(lows, "comp").select("node", "comp", "component_id")
    else:
        ids = ids.select("node", F.col("node").alias("comp"), F.col("low").alias("component_id"))
    ids = write_table(spark, ids, "components")
    out = out.join(ids, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "node", "comp")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, at_least: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each component, all columns. Rows of one doc_id in one component: one text stays."""
    spark = docs.sparkSession
    found = write_table(spark, near_duplicates(docs, doc_id, text, shingle, at_least), "near")
    full = F.col("n_shingles") > 0
    kept = found.filter("kept").groupBy("doc_id", F.when(full, F.col("comp")).alias("c"), F.when(~full, F.col("text_key")).alias("t")).agg(F.min("text_key").alias("text_key"))
    one = F.xxhash64(docs[text].cast("string"))
    marked = docs.withColumns({"__id": docs[doc_id].cast("long"), "__key": one})
    out = marked.join(kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")), F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__key") == F.col("__kept_key")), "left_semi")
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["__id", "__key"])
    return out.drop("__id", "__key")
