"""Byte-level byte-pair encoding in padded matrices, and decoding.

A text is cut into words by the tokenizer's pattern. The distinct words that a worker doesn't know yet are dealt into
buckets by length; a bucket is a matrix of token ids, one row a word, padded at the end. In each round every row merges
its leftmost pair of least rank: ranks stand beside the ids, those of pairs that a merge made new are looked up in a hash
table of all pairs, and rows that have nothing left to merge leave the matrix. Words over WIDE bytes, whose rounds would
grow with the square of their length, merge the same pairs from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import slices, text_bytes

#: Bytes of a word that goes into a matrix.
WIDE = 256
#: Ids of a matrix.
CELLS = 1 << 20
#: Words that a worker remembers, and their characters; at more it starts over.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8 << 20
#: Words of a long text that are taken at once.
WORDS_AT_ONCE = 200_000
#: Bytes of texts taken at once, and of a batch of results.
STEP = 2 << 20
NONE = np.iinfo(np.int32).max
EMPTY = np.uint64(2**64 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Splitter:
    """Words by the pattern, as tiktoken's own engine sees them. That engine may know other characters for letters, numbers
    or blanks than the one used here, by their versions of Unicode. So it is asked, and where the two differ, a character
    is looked at as a plain one of its class."""

    def __init__(self, pattern: str):
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        points = codes.tobytes().decode("utf-32-le")
        kind, known = np.full(0x110000, ord("#"), np.uint8), np.full(0x110000, ord("#"), np.uint8)
        for each, sign in ((r"\p{L}", "x"), (r"\p{N}", "0"), (r"\s", "\t")):
            theirs = bytes(tiktoken.Encoding("class", pat_str=each, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)).decode()
            for table, found in ((kind, theirs), (known, "".join(regex.findall(each, points)))):
                table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = ord(sign)
        self.plain = {c: chr(kind[c]) for c in np.flatnonzero(kind != known).tolist()}
        self.strange = {chr(c) for c in self.plain}
        self.pattern = regex.compile(pattern)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in lists of WORDS_AT_ONCE at most, if it is long."""
        seen = text if text.isascii() or self.strange.isdisjoint(text) else text.translate(self.plain)
        if seen is text and len(text) <= STEP:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(seen)
        while part := [text[slice(*m.span())] for m in islice(found, WORDS_AT_ONCE)]:
            yield part


class BytePairs:
    """A vocabulary of ranks: a token's id is its rank. Lives in a worker."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ids = read_ranks(ranks_path)
        self.of_byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)
        pairs = {(a, b): i for token, i in self.ids.items() for at in range(1, len(token)) if (a := self.ids.get(token[:at])) is not None and (b := self.ids.get(token[at:])) is not None}
        self.pairs = pairs
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), EMPTY, np.uint64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        self._fill(np.array([*pairs], np.uint64).reshape(-1, 2), np.array([*pairs.values()], np.int32))
        self.splitter = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _fill(self, pairs: np.ndarray, values: np.ndarray) -> None:
        """Puts every pair in its slot or in the next one that is free."""
        key = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        at = self._slots(key)
        while len(key):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = key[free]  # of several the last one stays
            mine = self.keys[at] == key
            self.values[at[mine]] = values[mine]
            key, at, values = key[~mine], (at[~mine] + 1) % len(self.keys), values[~mine]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        out = np.full(len(a), NONE, np.int32)
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, row = self._slots(key), np.arange(len(a))
        while len(row):
            there = self.keys[at]
            hit = there == key
            out[row[hit]] = self.values[at[hit]]
            on = ~hit & (there != EMPTY)
            row, key, at = row[on], key[on], (at[on] + 1) % len(self.keys)
        return out

    def merge(self, words: list[bytes], width: int) -> list[bytes]:
        """The packed ids of words of at most `width` bytes: rounds of merges in one matrix."""
        n = np.array([len(w) for w in words])
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(ids.shape, NONE, np.int32)
        pair = np.arange(width - 1) < n[:, None] - 1
        rank[:, :-1][pair] = self.ranks_of(ids[:, :-1][pair], ids[:, 1:][pair])
        out: list[bytes] = [b""] * len(words)
        row, column = np.arange(len(words)), np.arange(width)
        while len(row):
            best = rank.argmin(1)
            least = rank[np.arange(len(row)), best]
            for i in np.flatnonzero(least == NONE).tolist():
                out[row[i]] = ids[i, : n[i]].astype("<u4").tobytes()
            on = least != NONE
            ids, rank, n, row, best, least = ids[on], rank[on], n[on], row[on], best[on], least[on]
            if not len(row):
                break
            each = np.arange(len(row))
            behind = np.minimum(column + (column > best[:, None]), width - 1)  # what stands behind the pair moves up
            ids, rank = np.take_along_axis(ids, behind, 1), np.take_along_axis(rank, behind, 1)
            n = n - 1
            ids[each, best] = least
            ids[each, n], rank[each, n], rank[each, n - 1] = -1, NONE, NONE
            for beside, has in ((best - 1, best > 0), (best, best < n - 1)):
                i, j = each[has], beside[has]
                rank[i, j] = self.ranks_of(ids[i, j], ids[i, j + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one word, the least pair from a heap."""
        ids, n = self.of_byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of distinct words."""
        out, buckets = {}, {}
        for word in words:
            data = word.encode()
            whole = self.ids.get(data)
            if whole is not None:
                out[word] = whole.to_bytes(4, "little")
            elif len(data) > WIDE:
                out[word] = self.merge_long(data)
            else:
                buckets.setdefault(1 << (len(data) - 1).bit_length(), []).append((word, data))
        for width, bucket in buckets.items():
            for at in range(0, len(bucket), CELLS // width):
                part = bucket[at : at + CELLS // width]
                out.update(zip((word for word, _ in part), self.merge([data for _, data in part], width), strict=True))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text."""
        if sum(map(len, texts)) <= STEP:  # the words of all of them at once
            each = [list(chain.from_iterable(self.splitter.words(x))) for x in texts]
            self.learn(set().union(*each))
            for words in each:
                yield b"".join([self.known[w] for w in words])
            return
        for text in texts:
            out = []
            for words in self.splitter.words(text):
                self.learn(set(words))
                out.append(b"".join([self.known[w] for w in words]))
            yield b"".join(out)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        size = sum(map(len, fresh))
        if len(self.known) + len(fresh) > REMEMBERED or self.held + size > REMEMBERED_CHARS:
            self.known, self.held = {}, 0
            fresh = list(words)
            size = sum(map(len, fresh))
        self.held += size
        self.known |= self.encode_words(fresh)


_LOADED: dict[tuple[str, str], BytePairs] = {}


def loaded(ranks_path: str, pattern: str) -> BytePairs:
    key = (ranks_path, pattern)
    return _LOADED.get(key) or _LOADED.setdefault(key, BytePairs(*key))


def decoder(ids: dict[bytes, int]) -> Callable[[bytes], bytes]:
    """The bytes that packed ids stand for."""
    token = {i: x for x, i in ids.items()}
    return lambda packed: b"".join([token[i] for i in np.frombuffer(packed, "<u4").tolist()])


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """For every document: doc_id, n_tokens, and ids, its tokens' ids as little-endian unsigned 32-bit integers; with
    `decoded` also data, the bytes that these ids stand for (see decode_ids), decoded by the task that encoded them.

    Special tokens' strings are text like any other. A null or empty text has no tokens. Repeated rows, and rows without a
    doc_id, are encoded each for itself. An empty table gives no rows. Other columns of docs are not looked at."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(ranks_path, pattern)
        decode = decoder(pairs.ids)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for a, b in slices(np.diff(offsets), STEP):
                ids = list(pairs.encode([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]))
                out = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["data"] = pa.array([decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, n_tokens long, ids binary" + (", data binary" if decoded else ""))


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with data, the bytes that the ids stand for; null where ids is null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoder(read_ranks(ranks_path))
        for batch in batches:
            data = [None if x is None else bytes_of(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "data"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, data binary")
