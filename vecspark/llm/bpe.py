"""BPE encoding and decoding with a trie of distinct words.

A text is cut at ASCII white space into chunks. Each distinct chunk of a batch is normalised and cut into words once;
the distinct words, sorted, are the leaves of a trie that is walked depth first. At each node the walk keeps the last
token of the encoding of the prefix that ends there; a shared prefix is therefore encoded once. The last token of a
longer prefix is the longest vocabulary entry that ends there and that can follow the last token of what is left of it
(:meth:`WordTrie.fits`); such an entry exists and only one fits, because merges are applied by rank. Following the
last tokens back from a word's end gives its encoding.

Nulls are empty texts; an empty text has no tokens. Vocabulary files are a parameter (the JSON of the tokenizers
library: BPE with an end-of-word suffix over byte-level symbols); nothing is trained.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from vecspark.llm import textscan
from vecspark.session import ship

#: Text bytes that are encoded together: the words of so much text form one trie.
TOGETHER = 3 << 20
#: Words, and chunks, that a task remembers at most (some 150 and 40 bytes each); it then forgets.
WORDS, CHUNKS = 200_000, 1_000_000
U64 = np.uint64


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTrie:
    """Encodes sorted distinct words, given as bytes."""

    END = "</w>"

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.plain: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        size = max(vocab.values()) + 1
        self.length = [0] * size
        for text, i in vocab.items():
            ends = text.endswith(self.END) and text != self.END
            raw = bytes(byte_of[c] for c in (text[: -len(self.END)] if ends else text))
            (self.final if ends else self.plain)[raw] = i
            self.length[i] = len(raw)
        self.rank: dict[int, int] = {}
        self.parts: list[tuple[int, int, int] | None] = [None] * size  # left, right, rank of the merge that makes it
        for k, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            self.rank.setdefault(left << 20 | right, k)
            made = vocab.get(a + b)
            if made is not None and self.parts[made] is None:
                self.parts[made] = left, right, k
        self.plain_long, self.final_long = self._long(self.plain), self._long(self.final)
        self.plain_tails: dict[bytes, tuple] = {}
        self.final_tails: dict[bytes, tuple] = {}
        self._rights: dict[int, tuple] = {}
        self._lefts: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}

    #: Bytes of a tail whose candidates are kept.
    TAIL = 5

    @classmethod
    def _long(cls, tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
        """By their last TAIL bytes: lengths of the tokens longer than that, longest first."""
        found: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > cls.TAIL:
                found.setdefault(t[-cls.TAIL :], set()).add(len(t))
        return {tail: tuple(sorted(lengths, reverse=True)) for tail, lengths in found.items()}

    def _ending(self, tail: bytes, tokens: dict[bytes, int], long: dict[bytes, tuple[int, ...]], seen: dict[bytes, tuple]) -> tuple:
        """What can end in a tail (at most TAIL bytes): lengths of longer tokens to try, and the (length, id) of the others, longest first."""
        if len(seen) > 100_000:
            seen.clear()
        n = len(tail)
        out = seen[tail] = long.get(tail, ()), tuple((k, t) for k in range(n, 0, -1) if (t := tokens.get(tail[n - k :])) is not None)
        return out

    def _edge(self, token: int, side: int) -> tuple:
        """The symbols at a token's right (1) or left (0) end while it grows, each with the rank that consumes it."""
        out, consumed, at = [], 1 << 40, token
        while True:
            out.append((at, consumed))
            made = self.parts[at]
            if made is None:
                return tuple(out[::-1])
            consumed, at = made[2], made[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, joined, are encoded as a, b: no merge across the border comes first.

        Both sides grow by rank; a merge across wins if its rank is below that of the next merge on the left and not
        above that of the next on the right (of equal merges the leftmost is applied first).
        """
        known = self._fits.get(a << 20 | b)
        if known is not None:
            return known
        left = self._rights.get(a) or self._rights.setdefault(a, self._edge(a, 1))
        right = self._lefts.get(b) or self._lefts.setdefault(b, self._edge(b, 0))
        i = j = 0
        good = True
        while True:
            (x, p), (y, q) = left[i], right[j]
            across = self.rank.get(x << 20 | y)
            if across is not None and across < p and across <= q:
                good = False
                break
            if i == len(left) - 1 and j == len(right) - 1:
                break
            if p <= q:
                i += 1
            else:
                j += 1
        if len(self._fits) > 400_000:
            self._fits.clear()
        self._fits[a << 20 | b] = good
        return good

    @staticmethod
    def shared(words: list[bytes], width: int = 24) -> list[int]:
        """The number of bytes that each word shares with the word before, at most its length and at most ``width``."""
        if not words:
            return []
        grid = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        differ = np.ones((len(words) - 1, width + 1), bool)
        np.not_equal(grid[1:], grid[:-1], out=differ[:, :width])
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), width)
        return [0, *np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1])).tolist()]

    def encode(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word; words must be sorted, none may be empty."""
        plain, final, fits, length, known, most = self.plain, self.final, self.fits, self.length, self._fits, self.TAIL
        plain_tails, final_tails, ending = self.plain_tails, self.final_tails, self._ending
        path: list[int] = []  # the last token of each prefix of the word before
        for w, shared in zip(words, self.shared(words), strict=True):
            n = len(w)
            shared = min(shared, n - 1, len(path))
            del path[shared:]
            for i in range(shared + 1, n):  # the prefixes w[:i]
                tail = w[i - most : i] if i > most else w[:i]
                long, short = plain_tails.get(tail) or ending(tail, plain, self.plain_long, plain_tails)
                for size in long:
                    if size <= i and (t := plain.get(w[i - size : i])) is not None and (size == i or fits(path[i - size - 1], t)):
                        path.append(t)
                        break
                else:
                    for size, t in short:
                        if size == i or size == 1 or ((pair := path[i - size - 1] << 20 | t) in known and known[pair]) or (pair not in known and fits(path[i - size - 1], t)):
                            path.append(t)
                            break
            tail = w[-most:]
            long, short = final_tails.get(tail) or ending(tail, final, self.final_long, final_tails)
            token = size = None
            for size in long:
                if size <= n and (t := final.get(w[n - size :])) is not None and (size == n or fits(path[n - size - 1], t)):
                    token = t
                    break
            else:
                for size, t in short:
                    if size == n or size == 1 or ((pair := path[n - size - 1] << 20 | t) in known and known[pair]) or (pair not in known and fits(path[n - size - 1], t)):
                        token = t
                        break
            ids, i = [token], n - size
            while i:
                t = path[i - 1]
                ids.append(t)
                i -= length[t]
            ids.reverse()
            yield ids


class Encoder:
    """The whole way from texts to ids, equal to the tokenizers library on the same file (without special tokens)."""

    #: The pre-tokenizer's pattern for characters below U+0250, where \\w without digits and _ are letters.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_|[²³¹¼½¾])+")
    PLAIN = re.compile("[!-~¡-±´-¸º»¿-ɏ]*")

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            text = f.read()
        config = json.loads(text)
        model = config["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WordTrie.END or config.get("decoder"):
            raise ValueError(f"{file} is not a BPE vocabulary with an end-of-word suffix and no decoder")
        self.load(text, model)
        self.config = config | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.raw = lambda shown: bytes(map(byte_of.__getitem__, shown))
        self.name = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.name[i] = t
        self.code = "H" if len(self.name) <= 1 << 16 else "I"  # of the packed ids
        self.words: dict[bytes, bytes] = {}

    def load(self, text: str, model: dict) -> None:
        self.trie = WordTrie(model["vocab"], model["merges"])

    def encode_words(self, words: list[bytes]) -> Iterable[list[int]]:
        """The ids of each word; words are sorted and distinct."""
        return self.trie.encode(words)

    @cached_property
    def whole(self):
        """The library's own normaliser and pre-tokenizer, for texts beyond the plain characters; loaded when needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.config))

    def parts(self, chunk: bytes) -> list:
        """The words (bytes) and special tokens (ids) of a chunk without ASCII white space."""
        if chunk.isalpha():  # ASCII letters alone
            return [chunk.lower()]
        text = chunk.decode("utf-8", "replace")
        if "<|" not in text and self.PLAIN.fullmatch(text):
            return [w.encode() for w in self.WORDS.findall(text.lower())]
        out, at = [], 0
        for m in [*self.specials.finditer(text), None]:
            piece = text[at : m.start()] if m else text[at:]
            if piece:
                out += [self.raw(shown) for shown, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(piece))]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def encode_chunks(self, chunks: list[bytes]) -> Iterator[list[int]]:
        """The ids of each chunk."""
        for packed in self.packed_chunks(chunks):
            yield array(self.code, packed).tolist()

    def packed_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, packed as unsigned integers of type ``code``."""
        known, code = self.words, self.code
        if len(known) > WORDS:
            known.clear()
        cut = [self.parts(c) for c in chunks]
        fresh = sorted({w for parts in cut for w in parts if w.__class__ is bytes and w not in known})
        known.update(zip(fresh, (array(code, ids).tobytes() for ids in self.encode_words(fresh)), strict=True))
        return [known[parts[0]] if len(parts) == 1 and parts[0].__class__ is bytes else b"".join([known[w] if w.__class__ is bytes else array(code, [w]).tobytes() for w in parts]) for parts in cut]


class LibraryEncoder(Encoder):
    """The same, with the library's own model for each distinct word in place of the trie."""

    SYMBOLS = "".join(byte_symbols())

    def load(self, text: str, model: dict) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(text).model

    def encode_words(self, words: list[bytes]) -> Iterable[list[int]]:
        cut, shown = self.model.tokenize, codecs.charmap_decode
        return ([t.id for t in cut(shown(w, "strict", self.SYMBOLS)[0])] for w in words)


@lru_cache(maxsize=1)
def encoder(file: str) -> Encoder:
    """The encoder of a vocabulary file, for use outside tasks."""
    return Encoder(file)


def send_vocabulary(df: DataFrame, file: str) -> str:
    """Give every executor the vocabulary file (a fixed 1.7 MB, whatever the input)."""
    sc = df.sparkSession.sparkContext
    name = file.rsplit("/", 1)[-1]
    sent = sc.__dict__.setdefault("_vecspark_files", set())
    if file not in sent:
        sc.addFile(file)
        sent.add(file)
    return name


def together(batches: Iterable[pa.RecordBatch], column: int = 1, size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Joins small record batches up to a number of text bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def chunks_of(texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's bytes, its chunks' starts, ends and hashes, and the number of chunks before each text."""
    data, at = textscan.buffers(texts)
    starts, ends, first = textscan.spans(data, at, textscan.NOT_SPACE)
    return data.tobytes(), starts, ends, textscan.word_hashes(data, starts, ends), first


class Memory:
    """What a task remembers of chunks, by hash: packed arrays, which go when the task ends.

    Beyond the limit it forgets the chunks that one batch alone has had.
    """

    def __init__(self, file: str, limit: int = CHUNKS, encoder: type[Encoder] = Encoder):
        self.encoder, self.limit = encoder(SparkFiles.get(file) if "/" not in file else file), limit  # a file sent with addFile
        self.hashes, self.numbers = np.zeros(0, U64), np.zeros(0, np.int32)  # ascending hashes, and each one's number
        self.uses = np.zeros(0, np.int32)
        self.flat, self.ends = bytearray(), array("q", [0])  # packed ids of all numbers

    def kept(self, numbers: np.ndarray) -> None:
        """Called when only these numbers stay, to become 0, 1, 2 ..."""

    def _forget(self) -> None:
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > self.limit // 2:
            stay = stay[:0]
        to = np.full(len(self.uses), -1, np.int32)
        to[stay] = np.arange(len(stay))
        numbers = to[self.numbers]
        self.hashes, self.numbers = self.hashes[numbers >= 0], numbers[numbers >= 0]
        flat, cuts = self.joined(stay)
        self.flat, self.ends = bytearray(flat.tobytes()), array("q", (cuts * flat.itemsize).tolist())
        self.uses = np.ones(len(stay), np.int32)
        self.kept(stay)

    def look_up(self, raw: bytes, starts, ends, hashes) -> np.ndarray:
        """The number of each chunk, after encoding those not known."""
        if len(self.hashes) > self.limit:
            self._forget()
        if not len(hashes):
            return np.zeros(0, np.int32)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = np.flatnonzero(at < len(self.hashes))
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        numbers = np.empty(len(distinct), np.int32)
        numbers[known] = self.numbers[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            n = len(self.ends) - 1
            numbers[fresh] = np.arange(n, n + len(fresh))
            packed = self.encoder.packed_chunks([raw[a:b] for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)])
            self.flat += b"".join(packed)
            self.ends.extend((self.ends[-1] + np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))).tolist())
            self.hashes = np.insert(self.hashes, at[fresh], distinct[fresh])  # stays ascending
            self.numbers = np.insert(self.numbers, at[fresh], numbers[fresh])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])
        self.uses[numbers] += 1
        return numbers[inverse]

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, joined, and the number of ids before each chunk and at the end."""
        flat = np.frombuffer(self.flat, self.encoder.code)  # views: no copy of all that is remembered
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[numbers] // flat.itemsize
        n = ends[1:][numbers] // flat.itemsize - start
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(before[-1], dtype=np.int32)
        at += np.repeat((start - before[:-1]).astype(np.int32), n)
        return flat[at], before


class Strings(Memory):
    """With each chunk's ids in decimal and its decoded text."""

    def __init__(self, file: str, limit: int = CHUNKS // 4):
        super().__init__(file, limit)
        self.ids: list[bytes] = []
        self.text: list[bytes] = []
        self.count: list[int] = []

    def kept(self, numbers) -> None:
        for name in ("ids", "text", "count"):
            old = getattr(self, name)
            setattr(self, name, [old[k] for k in numbers.tolist()])

    def look_up(self, raw, starts, ends, hashes) -> np.ndarray:
        out = super().look_up(raw, starts, ends, hashes)
        names = self.encoder.name
        ids, cuts = self.joined(np.arange(len(self.count), len(self.uses)))
        ids, cuts = ids.tolist(), cuts.tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = ids[a:b]
            self.ids.append(b"%d" % own[0] if b - a == 1 else " ".join(map(str, own)).encode())
            self.text.append(" ".join([names[i] for i in own]).encode())
            self.count.append(b - a)
        return out


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", keep_texts: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the decoded
    text); with keep_texts also ids (decimal, joined by one space) and decoded. Decoding joins the tokens' strings with
    one space, as a vocabulary without a decoder asks for. One row for each input row, in no order; a null or empty
    text has 0 tokens and the hashes of an empty string; other columns of docs are ignored; a null doc_id stays null.
    """
    ship(docs.sparkSession)
    textscan.limit_batches(docs.sparkSession)
    name = send_vocabulary(docs, file)

    def run(batches):
        store = Strings(name)
        for batch in together(batches):
            raw, starts, ends, hashes, first = chunks_of(batch.column(1))
            numbers = store.look_up(raw, starts, ends, hashes)
            rows: list[tuple] = []
            cuts = first.tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = [k for k in numbers[a:b].tolist() if store.count[k]]
                ids, decoded = b" ".join([store.ids[k] for k in own]), b" ".join([store.text[k] for k in own])
                rows.append((sum([store.count[k] for k in own]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids.decode(), decoded.decode()) if keep_texts else ())))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 if keep_texts else 3)
            kinds = [pa.int64(), *[pa.string()] * (len(columns) - 1)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names[: len(columns) + 1])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(textscan.lean(run), ENCODED + (", ids string, decoded string" if keep_texts else ""))


def decode(ids: Iterable[int], file: str) -> str:
    """The text of ids, special tokens included."""
    names = encoder(file).name
    return " ".join(names[i] for i in ids)
