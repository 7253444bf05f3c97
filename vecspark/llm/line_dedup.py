"""Line dedup: an exact set-similarity self-join of all lines, which removes later matches.

A line's tokens are its distinct words (A-Z lower-cased, split at ASCII white space). A line is removed if an earlier
line, by (doc_id, line number), has the same tokens or a Jaccard similarity of at least ``at_least``. Lines without
words stay. The join, for a line of n tokens ordered by rarity in the corpus, rarest first:

1. Lines with equal token sets are one node: the first of them stands for all, and later ones go.
2. Rarity is a count in a table of fixed size (2 ** SLOTS), filled from all lines; tokens that share a slot count
   together, which changes the order but not the result: any fixed order is right. A slot that counts 1 holds a token
   of a single line, which can't match and is left out.
3. Prefix filter: two lines that match share a token among the first n - ceil(t n) + 1 of each. Where their first
   common token is frequent, so are all later ones; then they share two among one more, and that pair is the key. So
   single keys are rare by construction and frequent ones are split by a second token.
4. Length filter (sizes within a factor t) and positional filter (what can follow the first common token), then a
   bitmap filter (the parities of 128 classes of tokens bound the difference from below), all on packed arrays, sorted
   by key and size. Postings come in buckets of keys, as many as the input asks for, and are taken bucket by bucket.
5. Of a line's earlier candidates, each bucket keeps the BEST most alike by bitmap, and all where the
   bitmaps leave the best one in doubt (equally many of each such line, once they are SPARE times the lines with
   candidates: pairs never grow faster than lines). The best of all is verified on the full token sets, then the others of lines without a
   match; lines that still have none and had more candidates are matched with all of them in one further pass. It reads
   no texts: a bucket leaves behind the postings of lines that lose candidates and of those candidates, at most one for
   each of its own. So one match settles a line, groups of near copies make no pairs in square, and no line is left
   undecided.

Up to three tokens a match means equal sets. Postings of lines that occur very often come from their first occurrence
alone. Nulls count as empty texts; a null doc_id comes first; rows equal in doc_id and text are treated alike; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textscan
from vecspark.llm.near_dedup import fixed, node_keys, small
from vecspark.session import Scratch, ship

#: log2 of the rarity table's size and of its parts' size; the count from which on a token is frequent; nodes named at most.
SLOTS, PART, FREQUENT, NAMED = 24, 16, 4000, 100_000
#: Candidates of a line that a bucket keeps; pairs a line that it keeps for all lines in doubt; pairs held before they are thinned; postings of a bucket, about.
BEST, SPARE, HELD, BUCKET = 2, 4, 2_000_000, 250_000
#: Pairs, lines or texts that are broadcast at most (of 3 to 6 numbers: some 30 MB); postings in a row of those left for a second pass.
FEW, PIECE = 300_000, 16_384
U64 = np.uint64
POSTING = np.dtype([("key", "<u8"), ("bits", "<u8", 2), ("doc", "<i8"), ("line", "<u4"), ("tag", "<u4"), ("n", "<u4"), ("node", "<u4"), ("at", "<u2")])
LINE = ["doc", "line", "tag"]
#: The n of a posting without a key, which says that its line wants all its candidates.
WANTED = np.uint32(1 << 31)
#: By the number of parities apart: how many tokens differ (d of them put some 64 (1 - exp(-d / 64)) of 128 parities apart), and
#: a quarter and one more. A pair's score is this in thousandths of one more than may differ; up to SURE a match is as good as certain.
LIKELY = np.concatenate([1 - 80 * np.log1p(-np.arange(64) / 64), np.full(65, 1e6)])
SURE = 300
#: Bytes of a token that are hashed eight at a time; masks of the first 0 to 8 bytes of eight.
LONG, ENDS = 64, np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def in_rows(row: np.ndarray, tokens: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """The order by row (ascending already), level and token: one sort of packed keys, unless they are too short."""
    if len(row) and row[-1] < 1 << 20:
        low = tokens >> U64(20) if level is None else (level.astype(U64) << U64(36)) | (tokens >> U64(28))
        packed = (row.astype(U64) << U64(44)) | low
        order = np.argsort(packed)
        packed, own = packed[order], tokens[order]
        if not ((packed[1:] == packed[:-1]) & (own[1:] != own[:-1])).any():
            return order
    return np.lexsort((tokens, row) if level is None else (tokens, level, row))


def lines_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes of each line with words, ascending, their number before each; each line's text and number."""
    data, at = textscan.buffers(texts)
    starts, ends, first = textscan.spans_inside((data != 32) & (data - np.uint8(9) > 4), at)
    hashes = token_hashes(data, starts, ends)
    breaks = np.flatnonzero(data == 10)
    new = np.zeros(len(starts) + 1, bool)
    new[np.searchsorted(starts, breaks)] = True
    new[first[:-1]] = True
    new = new[:-1]
    begin = starts[new]
    text = np.searchsorted(at, begin, side="right") - 1
    line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, at[:-1])[text]
    row = np.cumsum(new) - 1
    h = hashes[in_rows(row, hashes)]  # rows stay where they are
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | new[1:]
    count = np.bincount(row[keep], minlength=len(begin))
    return h[keep], np.concatenate([[0], np.cumsum(count)]), text, line


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z as a-z: eight bytes at a time, spans beyond LONG bytes as a polynomial."""
    n = ends - starts
    low = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=low[: len(data)])
    eight = low.view("<u8")

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        k, off = at >> 3, (at & 7).astype(U64) << U64(3)
        return ((eight[k] >> off) | ((eight[k + 1] << (U64(63) - off)) << U64(1))) & ENDS[np.minimum(left, 8)]

    out = textscan.mix(load(starts, n) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93)))
    more, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(more):
        out[more] = textscan.mix(out[more] * U64(0x9E3779B97F4A7C15) + load(starts[more] + done, n[more] - done))
        done += 8
        more = more[n[more] > done]
    long = np.flatnonzero(n > LONG)
    if len(long):
        out[long] = textscan.word_hashes(data, starts[long], ends[long], lower=True)
    return out


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SLOTS)).astype(np.int64)


LINES = "node binary, doc long, tag long, line int, n int, of int, part int, counts binary"


def read_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with words, and at the end of each task its counts by slot, packed for each part of the table.

    n: the line's tokens; of: the number of such lines in its text, in the row of the first one.
    """
    names = ["node", "doc", "tag", "line", "n", "of", "part", "counts"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        total = np.zeros(1 << SLOTS, np.uint32)
        for b in batches:
            tokens, cuts, text, line = lines_of(b.column(2))
            np.add.at(total, slots(tokens), np.uint32(1))
            own = pa.array(text)
            of = pa.array(np.bincount(text)[text].astype(np.int32), mask=np.diff(text, prepend=-1) == 0)
            yield pa.RecordBatch.from_arrays([fixed(node_keys(tokens, cuts)), b.column(0).take(own), b.column(1).take(own), pa.array(line.astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), of, pa.nulls(len(text), pa.int32()), pa.nulls(len(text), pa.binary())], names)
        for k, part in enumerate(total.reshape(-1, 1 << PART)):
            if len(used := np.flatnonzero(part)):
                packed = used.astype("<u2").tobytes() + part[used].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names)

    return docs.select("doc", "tag", "text").mapInArrow(textscan.lean(run), LINES)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as levels of 8 bits that keep their order: 0 for 1, then eight for each doubling."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def rarity_table(lines: DataFrame) -> np.ndarray:
    """The level of each slot (16 MB, whatever the input), from all tasks' counts."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = packed.as_buffer()
                n = raw.size // 6
                total.setdefault(k, np.zeros(1 << PART, np.int64))[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        for k, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels(counts).tobytes()], pa.binary())], ["part", "levels"])

    counts = lines.filter("part is not null").select("part", "counts").repartition("part")
    out = np.zeros(1 << SLOTS, np.uint8)
    for row in counts.mapInArrow(textscan.lean(run), "part int, levels binary").collect():
        out[row["part"] << PART : (row["part"] + 1) << PART] = np.frombuffer(row["levels"], np.uint8)
    return out


def keys_of(tokens: np.ndarray, cuts: np.ndarray, level: np.ndarray, num: int, den: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all lines: the line, the key, and the place of the key's first token in the line's order."""
    n = np.diff(cuts)
    row = np.repeat(np.arange(len(n)), n)
    own = level[slots(tokens)]
    order = in_rows(row, tokens, own)
    place = np.arange(len(tokens)) - cuts[:-1][row]
    t, lev = tokens[order], own[order]
    size = n[row]
    prefix = size - (-(-size * num // den)) + 1
    long = size > 3
    single = np.flatnonzero(long & (place < prefix) & (lev > 0) & (lev < frequent))
    rows, keys, at = [row[single]], [t[single]], [place[single]]
    many = long & (place < prefix + 1) & (lev >= frequent)
    first = np.flatnonzero(many)
    gap = 1
    while len(first):
        first = first[first + gap < len(t)]
        first = first[(row[first + gap] == row[first]) & many[first + gap]]
        rows.append(row[first])
        keys.append(textscan.mix(t[first] * U64(3) + t[first + gap]))
        at.append(place[first])
        gap += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(at)


def bitmaps(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The parities of each line's tokens by 128 classes: as many tokens differ, at least, as bits."""
    out = np.zeros((len(cuts) - 1, 2), U64)
    if len(tokens):
        bit, high = U64(1) << (tokens & U64(63)), (tokens & U64(64)) > 0
        for k in range(2):
            out[:, k] = np.bitwise_xor.reduceat(np.where(high == bool(k), bit, U64(0)), cuts[:-1])
    return out


def candidates(key: np.ndarray, n: np.ndarray, bits: np.ndarray, at: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of postings, sorted by key and n, that pass the filters, and their scores."""
    n, at = n.astype(np.int64), at.astype(np.int64)
    live, gap = np.arange(len(key)), 1
    while True:
        live = live[live + gap < len(key)]
        other = live + gap
        go = (key[other] == key[live]) & (n[other] * num <= n[live] * den)  # sorted by n: who fails once fails on
        live, other = live[go], other[go]
        if not len(live):
            return
        a, b = n[live], n[other]
        need = -(-num * (a + b) // (num + den))
        good = np.minimum(a - at[live], b - at[other]) >= need
        x, y = live[good], other[good]
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        room = (a + b - 2 * need)[good]
        close = (apart <= room) & (room > 0)  # no room: equal sets alone match, and those are one node
        if close.any():
            yield x[close], y[close], (1000 * LIKELY[apart[close]] / (room[close] + 1)).astype(np.int64)
        gap += 1


def thinned(later: np.ndarray, earlier: np.ndarray, score: np.ndarray, more: np.ndarray, lost: np.ndarray, best: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and of each later line the few best, of lines in doubt as many as there is room for; more, lost: get marks for lines that lose candidates and for those candidates."""
    order = np.lexsort((earlier, score, later))
    later, earlier, score = later[order], earlier[order], score[order]
    new = np.ones(len(later), bool)
    new[1:] = (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])
    later, earlier, score = later[new], earlier[new], score[new]
    if best is None:
        return later, earlier, score
    first = np.flatnonzero(np.diff(later, prepend=-1))
    each = np.diff(first, append=len(later))
    place = np.arange(len(later)) - np.repeat(first, each)
    few, spare, sure = best
    doubt = score[first] > sure
    most = int(each.max(initial=few))
    while most > few and np.minimum(each[doubt], most).sum() > spare * len(first):
        most = max(few, most // 2)
    keep = place < np.repeat(np.where(doubt, max(few, most), few), each)
    more[later[~keep]], lost[earlier[~keep]] = True, True
    return later[keep], earlier[keep], score[keep]


PAIRS = "doc long, line int, tag long, of_doc long, of_line int, of_tag long, score int, whole boolean, bucket int, postings binary"


def numbered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of postings in order of doc, line and tag, and the place of each posting's line there: one sort of packed keys, where they fit."""
    doc, line, tag = (np.ascontiguousarray(p[c]) for c in LINE)
    low, width = int(doc.min()), int(line.max()).bit_length()
    order = None
    if (int(doc.max()) - low).bit_length() + width <= 64:
        packed = ((doc - low).astype(U64) << U64(width)) | line
        order = np.argsort(packed)
        packed, own = packed[order], tag[order]
        if ((packed[1:] == packed[:-1]) & (own[1:] != own[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((tag, line, doc))
    new = np.ones(len(p), bool)
    new[1:] = False
    for c in (doc[order], line[order], tag[order]):
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(p), np.int64)
    number[order] = np.cumsum(new) - 1
    return p[LINE][order[new]], number


def by_key(key: np.ndarray, size: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The order by key, size and node (its first bits, if there are very many keys or long lines)."""
    order = np.argsort(key)
    sorted_keys = key[order]
    rank = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    width = int(size.max()).bit_length()
    spare = min(32, 64 - width - int(rank[-1]).bit_length())
    packed = (((rank.astype(U64) << U64(width)) | size[order]) << U64(spare)) | (node[order] >> np.uint32(32 - spare))
    return order[np.argsort(packed)]


def in_bucket(p: np.ndarray, num: int, den: int, best: tuple[int, int, int] | None, left: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """The candidates among a bucket's postings; best: BEST, SPARE and SURE (None: all pairs stay, of wanted lines alone).

    left: gets the postings of lines that lose candidates and of those candidates, where they share a key.
    """
    names, number = numbered(p)
    more, lost = np.zeros(len(names), bool), np.zeros(len(names), bool)
    wanted = np.ones(len(names), bool)
    if best is None:
        wanted[:] = False
        wanted[number[p["n"] == WANTED]] = True
        use = (p["n"] != WANTED) & np.isin(p["key"], p["key"][wanted[number]])
        p, number = p[use], number[use]
    key, size, node = np.ascontiguousarray(p["key"]), p["n"], np.ascontiguousarray(p["node"])
    order = by_key(key, size, node) if len(p) else np.zeros(0, np.int64)
    key, size, node, number, bits, at = key[order], size[order], node[order], number[order], p["bits"][order], p["at"][order]
    if best is not None:  # of lines with equal sets, the first
        new = np.ones(len(p), bool)
        new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (node[1:] != node[:-1]) | (bits[1:] != bits[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        key, size, bits, at, number, order = key[first], size[first], bits[first], at[first], np.minimum.reduceat(number, first), order[first]
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    fresh: list[tuple[np.ndarray, ...]] = []

    def thin() -> tuple[np.ndarray, ...]:
        return thinned(*(np.concatenate([old, *new]) for old, new in zip(kept, zip(*fresh, strict=True), strict=True)), more, lost, best)

    held = 0
    for x, y, d in candidates(key, size, bits, at, num, den):
        a, b = np.maximum(number[x], number[y]), np.minimum(number[x], number[y])
        keep = (a != b) & wanted[a]
        fresh.append((a[keep], b[keep], d[keep]))
        held += len(fresh[-1][0])
        if held > HELD:
            kept, fresh, held = thin(), [], 0
    if fresh:
        kept = thin()
    if left is not None and more.any():
        use = np.flatnonzero((more | lost)[number])
        use = use[np.isin(key[use], key[more[number]])]
        left.append(p[order[use]])
        for c in LINE:
            left[-1][c] = names[c][number[use]]
    later, earlier, score = kept
    columns = [names[at][c].astype(t) for at in (later, earlier) for c, t in zip(LINE, (np.int64, np.int32, np.int64), strict=True)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(score.astype(np.int32)), pa.array(~more[later])], ["doc", "line", "tag", "of_doc", "of_line", "of_tag", "score", "whole"])


def matched(postings: DataFrame, num: int, den: int, best: tuple[int, int, int] | None) -> DataFrame:
    """Pairs of a line and an earlier candidate; whole: whether all candidates of the line in this bucket are given.

    postings: (bucket, postings), those of a bucket together. Rows without a line hold, in pieces, what a further pass
    needs of a bucket where lines lose candidates.
    """
    names = [x.split()[0] for x in PAIRS.split(", ")]

    def pairs(bucket, held):
        left: list[np.ndarray] = []
        found = in_bucket(np.frombuffer(b"".join(held), POSTING), num, den, best, left if best else None)
        n = len(found)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(n, bucket, np.int32)), pa.nulls(n, pa.binary())], names)
        for p in left:
            for k in range(0, len(p), PIECE):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in found.columns), pa.array([bucket], pa.int32()), pa.array([p[k : k + PIECE].tobytes()], pa.binary())], names)

    def run(batches):
        held: list[bytes] = []
        last = None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != last and held:
                    yield from pairs(last, held)
                    held = []
                last = k
                held.append(raw.as_py())
        if held:
            yield from pairs(last, held)

    return postings.mapInArrow(textscan.lean(run), PAIRS)


def verified(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The lines (doc, line, tag) of the pairs whose full sets are similar enough."""

    def run(batches):
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column(3), b.column(4), strict=True)):
                both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")]))
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = den * shared >= num * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(good)) for k in range(3)], LINE)

    pairs = pairs.select(*LINE, "of_doc", "of_line", "of_tag")
    of = members.select(F.col("doc").alias("of_doc"), F.col("line").alias("of_line"), F.col("tag").alias("of_tag"), F.col("members").alias("ys"))
    of = of.join(small(pairs.select("of_doc", "of_line", "of_tag").distinct(), FEW), ["of_doc", "of_line", "of_tag"], "left_semi")
    joined = members.join(small(pairs, FEW), LINE).join(of, ["of_doc", "of_line", "of_tag"])
    return joined.select(*LINE, "members", "ys").mapInArrow(textscan.lean(run), "doc long, line int, tag long").distinct()


def later_lines(docs: DataFrame, lines: DataFrame, again: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The lines (doc, line, tag) that have an earlier line of similar tokens. docs: doc, tag, text."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(rarity_table(lines))
    total, about = lines.filter("part is null").agg(F.count("*"), F.sum(F.expr(f"n - ceil(n * {num} / {den}) + 1"))).first()
    often = again.filter(F.col("times") > max(2, total // NAMED)).select("node", "first.doc", "first.line", "first.tag").toArrow().to_pylist()  # at most NAMED rows
    named = spark.sparkContext.broadcast({bytes(r["node"]): (r["doc"], r["line"], r["tag"]) for r in often})
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(4 * parts, (about or 0) // BUCKET)
    frequent = int(levels(np.array([FREQUENT]))[0])

    def post(batches):
        first = named.value
        for b in batches:
            tokens, cuts, text, line = lines_of(b.column(2))
            if not len(tokens):
                continue
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, keys, at = keys_of(tokens, cuts, rarity.value, num, den, frequent)
            nodes = node_keys(tokens, cuts)
            if first:
                places = [first.get(k) for k in nodes.tolist()]
                use = np.array([f is None or f == (doc[t], x, tag[t]) for f, t, x in zip(places, text.tolist(), line.tolist(), strict=True)], bool)
                rows, keys, at = rows[use[rows]], keys[use[rows]], at[use[rows]]
            size = np.diff(cuts).astype(np.uint32)
            bucket = (keys >> U64(20)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, out = rows[order], np.empty(len(rows), POSTING)
            out["key"], out["n"], out["at"] = keys[order], size[rows], np.minimum(at[order], 65535)
            out["node"] = nodes.view(">u4").reshape(-1, 4)[rows, 0]
            out["bits"], out["doc"], out["line"], out["tag"] = bitmaps(tokens, cuts)[rows], doc[text[rows]], line[rows], tag[text[rows]]
            full, where = np.unique(bucket[order], return_index=True)
            raw, size, where = out.tobytes(), POSTING.itemsize, [*where.tolist(), len(out)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([raw[x * size : y * size] for x, y in zip(where[:-1], where[1:], strict=True)], pa.binary())], ["bucket", "postings"])

    def flags(batches):
        for b in batches:
            out = np.zeros(len(b), POSTING)
            out["n"] = WANTED
            for k, c in enumerate(LINE, 1):
                out[c] = b.column(k).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["bucket", "postings"])

    def dealt(postings: DataFrame) -> DataFrame:
        return postings.repartition(parts, "bucket").sortWithinPartitions("bucket")

    posted = docs.select("doc", "tag", "text").mapInArrow(textscan.lean(post), "bucket int, postings binary")
    found = scratch.write(matched(dealt(posted), num, den, (BEST, SPARE, SURE)), "pairs")
    pairs, left = found.filter("doc is not null").drop("postings"), found.filter("doc is null").select("bucket", "postings")
    members = scratch.write(token_sets(docs, pairs, scratch), "members")
    best = pairs.groupBy(*LINE).agg(F.min(F.struct("score", "of_doc", "of_line", "of_tag")).alias("b")).select(*LINE, "b.of_doc", "b.of_line", "b.of_tag")
    best = scratch.write(best, "best")
    done = scratch.write(verified(best, members, num, den), "later")
    others = pairs.join(small(done, FEW), LINE, "left_anti").join(small(best, FEW), [*LINE, "of_doc", "of_line", "of_tag"], "left_anti")
    others = scratch.write(others.select(*LINE, "of_doc", "of_line", "of_tag").distinct(), "others")
    done = scratch.write(done.unionByName(verified(others, members, num, den)), "later")
    undecided = scratch.write(pairs.filter("not whole").select(*LINE).distinct().join(small(done, FEW), LINE, "left_anti"), "undecided")
    if undecided.limit(1).count():
        wanted = pairs.filter("not whole").select("bucket", *LINE).distinct().join(small(undecided, FEW), LINE, "left_semi")
        wanted = scratch.write(wanted.select("bucket", *LINE), "wanted")
        left = left.join(small(wanted.select("bucket").distinct(), FEW), "bucket", "left_semi")
        rest = dealt(wanted.mapInArrow(textscan.lean(flags), "bucket int, postings binary").unionByName(left))
        every = scratch.write(matched(rest, num, den, None).filter("doc is not null").select(*LINE, "of_doc", "of_line", "of_tag").distinct(), "pairs")
        theirs = scratch.write(token_sets(docs, every, scratch), "members")
        done = scratch.write(done.unionByName(verified(every, theirs, num, den)).distinct(), "later")
    return done


def token_sets(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, line, tag and the token set (8 bytes a token, ascending) of every line of the pairs."""
    ends = pairs.select(*LINE).unionByName(pairs.select(F.col("of_doc").alias("doc"), F.col("of_line").alias("line"), F.col("of_tag").alias("tag")))
    wanted = scratch.write(ends.distinct().groupBy("doc", "tag").agg(F.sort_array(F.collect_list("line")).alias("wanted")), "wanted")  # of one text

    def run(batches):
        for b in batches:
            tokens, cuts, text, line = lines_of(b.column(2))
            sets = [set(w) for w in b.column(3).to_pylist()]
            own = np.array([k for k, (t, x) in enumerate(zip(text.tolist(), line.tolist(), strict=True)) if x in sets[t]], np.int64)
            raw, at, texts = tokens.astype("<u8").tobytes(), (cuts * 8).tolist(), pa.array(text[own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(texts), pa.array(line[own].astype(np.int32)), b.column(1).take(texts), pa.array([raw[at[k] : at[k + 1]] for k in own.tolist()], pa.binary())], [*LINE, "members"])

    rows = docs.select("doc", "tag", "text").join(small(wanted, FEW), ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    found = rows.mapInArrow(textscan.lean(run), "doc long, line int, tag long, members binary")
    return found.dropDuplicates(LINE)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: tuple[int, int] = (80, 100), keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_lines (with words), n_removed, removed (line numbers from 0, ascending).

    With keep_text also text without the removed lines and its SHA-256; only then texts are shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    num, den = at_least
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    of = docs[doc_id].cast("long")
    picked = docs.select(of.alias("doc_id"), F.coalesce(of, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(whole).bitwiseAND(0xFFFFFFFF).alias("tag"), whole.alias("text"))
    scratch, kept = Scratch(spark), Scratch(spark)
    lines = scratch.write(read_lines(picked), "lines")
    own = lines.filter("part is null").select("node", *LINE)
    twice = scratch.write(own.groupBy("node").count().filter("count > 1").select("node"), "twice")
    repeated = scratch.write(own.join(small(twice, FEW), "node"), "repeated")
    again = scratch.write(repeated.groupBy("node").agg(F.min(F.struct(*LINE)).alias("first"), F.count("*").alias("times")), "again")
    later = later_lines(picked, lines, again, num, den, scratch)
    gone = repeated.join(small(again, FEW), "node").filter(F.struct(*LINE) != F.col("first")).select(*LINE).unionByName(later)
    gone = gone.distinct().groupBy("doc", "tag").agg(F.sort_array(F.collect_list("line")).alias("removed"))  # of one text
    rows = lines.filter("of is not null").groupBy("doc", "tag").agg(F.max("of").alias("n_lines"))
    info = kept.write(rows.join(gone, ["doc", "tag"], "left"), "removed")
    scratch.drop()
    out = picked.join(info, ["doc", "tag"], "left").select("doc_id", *(["text"] if keep_text else []), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    if not keep_text:
        return out

    def rebuild(batches):
        for b in batches:
            rows = []
            for t, drop in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                lost = set(drop)
                kept = t if not lost else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
                rows.append((kept, hashlib.sha256(kept.encode()).hexdigest()))
            kept, sha = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), b.column(2), b.column(3), b.column(4), pa.array(sha, pa.string())], ["doc_id", "text", "n_lines", "n_removed", "removed", "text_sha256"])

    return out.mapInArrow(textscan.lean(rebuild), "doc_id long, text string, n_lines long, n_removed long, removed array<int>, text_sha256 string")
