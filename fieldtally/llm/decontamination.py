"""Benchmark decontamination by spaced seeds.

A mask looks at some of the words in a row and ignores the others, so that a hash of what it sees survives substituted
words. Hashes of the benchmark's passages are joined with those of all documents; every hit names an alignment of a
passage with a document, which is then verified: the best run of the alignment, where an equal word scores 1 and a
substituted one costs PENALTY, must score MIN_SCORE (or nearly all of a shorter passage).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import PLAIN, documents, mix, slices, text_bytes, word_hashes

#: Fixed masks: 1 is looked at, 0 ignored.
MASKS = ("111111", "1101100111", "110100110101", "111010010111")
#: What a substituted word costs.
PENALTY = 1
#: Score of the best run from which a document is contaminated; a passage of fewer words needs SHORT of its words.
MIN_SCORE = 12
SHORT = 0.8
#: Passages of fewer words must stand whole; those of fewer than a parameter's hit nothing.
WHOLE = 6
MIN_WORDS = 1
#: Seed hits that are expanded at once, and those of one seed in a row from which only their shifts are marked.
EXPANDED, MARKED = 1 << 20, 1 << 16
#: Seeds of the benchmark up to which they are broadcast (16 bytes each); more are joined by shuffling.
BROADCAST_SEEDS = 4_000_000
#: Cells of the bit table that most documents' seeds are turned away by.
FILTER_BITS = 22


def seeds(hashes: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the mask fits into a row, and the hashes of the words it looks at there."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[:n] == rows[len(mask) - 1 :])
    out = np.full(len(at), MASKS.index(mask) + 1 if mask in MASKS else len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i]
    return at, mix(out)


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Score, start and end of the best run of an alignment."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(gain.argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return int(gain[end]), start, end


def masks_of(min_words: int) -> tuple[str, ...]:
    """The spaced masks, and those of whole passages that are too short for them."""
    return MASKS + tuple("1" * k for k in range(min_words, WHOLE))


def item_seeds(hashes: np.ndarray, rows: np.ndarray, mask: str, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of passages: a mask of a short passage fits those of just its length."""
    at, h = seeds(hashes, rows, mask)
    if len(mask) >= WHOLE:
        return at, h
    exact = np.bincount(rows, minlength=n_rows)[rows[at]] == len(mask)
    return at[exact], h[exact]


class Bench:
    """A benchmark's words and seeds, as arrays."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        raw, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.min_words = min_words
        self.words, _, _, rows = word_hashes(raw, offsets, PLAIN)
        self.first = np.searchsorted(rows, np.arange(len(items) + 1))
        self.item_of = rows
        self.seeds = {}
        for mask in masks_of(min_words):
            at, h = item_seeds(self.words, rows, mask, len(items))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds[mask] = (h[order], at[order], bits)

    def hits(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item, shift) of all seed hits: shift is the place of the item's first word in all words. A word
        that fills both sides hits with everything: of such a seed only the shifts are marked, and the hits of others are
        expanded and made distinct a part at a time."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, (known, places, bits) in self.seeds.items():
            if not len(known):
                continue
            at, h = seeds(words, rows, mask)
            near = bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            at, h = at[near], h[near]
            lo = np.searchsorted(known, h, "left")
            n = np.searchsorted(known, h, "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            # one group for each row and seed; lo names the seed
            order = np.lexsort((at, lo, rows[at]))
            at, lo, n = at[order], lo[order], n[order]
            new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (rows[at[1:]] != rows[at[:-1]])])
            size = np.bincount(np.cumsum(new) - 1)
            first, many = np.flatnonzero(new), size * n[new] > MARKED
            for a, k in zip(first[many].tolist(), size[many].tolist(), strict=True):
                out += self._marked(at[a : a + k], places[lo[a] : lo[a] + n[a]], int(rows[at[a]]))
            usual = ~np.repeat(many, size)
            at, lo, n = at[usual], lo[usual], n[usual]
            for a, b in slices(n, EXPANDED):
                m = n[a:b]
                ahead = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                place, here = places[ahead], np.repeat(at[a:b], m)
                item = self.item_of[place]
                out = [np.unique(np.concatenate([*out, np.stack([rows[here], item, here - (place - self.first[item])], 1)]), axis=0)]
        return np.unique(np.concatenate(out), axis=0)

    def _marked(self, at: np.ndarray, places: np.ndarray, row: int) -> list[np.ndarray]:
        """The shifts of one seed's places in a row against its places in each item, without a row for each pair."""
        out = []
        items = self.item_of[places]
        for item in np.unique(items).tolist():
            inside = places[items == item] - self.first[item]
            low = int(at.min() - inside.max())
            hit = np.zeros(int(at.max() - inside.min()) - low + 1, bool)
            few, lots, sign = (inside, at, -1) if len(inside) <= len(at) else (at, inside, 1)
            for x in few.tolist():
                hit[(lots - x if sign < 0 else x - lots) - low] = True
            shifts = np.flatnonzero(hit) + low
            out.append(np.stack([np.full(len(shifts), row), np.full(len(shifts), item), shifts], 1))
        return out

    def needed(self, n: int) -> int:
        """The score that a passage of n words must reach."""
        return n if n < WHOLE else min(MIN_SCORE, max(WHOLE - 1, int(np.ceil(SHORT * n))))

    def verify(self, words: np.ndarray, first: np.ndarray, found: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(row, item) -> score, matched words, first and end word in the row, of the best verified alignment. first:
        bounds of the rows in words."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for row, item, shift in found.tolist():
            a, b = int(self.first[item]), int(self.first[item + 1])
            best = out.get((row, item), (0,))[0]
            if b - a < self.min_words or best == b - a:  # nothing is better than the whole passage
                continue
            lo, hi = max(shift, int(first[row])), min(shift + b - a, int(first[row + 1]))
            equal = words[lo:hi] == self.words[a + lo - shift : a + hi - shift]
            score, x, y = best_run(equal)
            if score >= self.needed(b - a) and score > best:
                out[row, item] = (score, int(equal[x:y].sum()), lo + x - int(first[row]), lo + y - int(first[row]))
        return out


COLUMNS = "doc_id long, item_id long, score int, matched int, first_word int, end_word int"


def _rows(ids: np.ndarray, bench: Bench, found: dict) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "score", "matched", "first_word", "end_word"]
    table = np.array([(ids[row], bench.ids[item], *x) for (row, item), x in found.items()], np.int64).reshape(-1, 6)
    return pa.RecordBatch.from_arrays([pa.array(table[:, i].astype(np.int64 if i < 2 else np.int32)) for i in range(6)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document and benchmark item that share a passage: doc_id, item_id, score, matched words, first and
    end word of the passage in the document. Words are runs of letters, digits and all that is not ASCII, lower-cased.

    Null and empty texts on either side hit nothing; rows whose doc_id or item_id is null are left out; repeated rows give
    one row; empty tables give none. Passages of fewer than min_words words hit nothing (1, the default, counts them all); those under
    WHOLE words must stand whole. A benchmark of more than broadcast_seeds seeds is joined by shuffling instead of
    being broadcast."""
    spark = docs.sparkSession
    docs = documents(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # A word takes two bytes at least, so the bytes bound the number of seeds before anything is collected.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // 2 * len(masks_of(min_words))
    if size > broadcast_seeds:
        return _by_shuffle(docs, items, min_words)
    bench = Bench([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()], min_words)
    held = spark.sparkContext.broadcast(bench)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in slices(np.diff(offsets)):
                words, _, _, rows = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PLAIN)
                found = bench.hits(words, rows)
                yield _rows(ids[a:b], bench, bench.verify(words, np.searchsorted(rows, np.arange(b - a + 1)), found))

    return _best(docs.mapInArrow(look, COLUMNS))


def _best(rows: DataFrame) -> DataFrame:
    """The best alignment of each document and item."""
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "matched", (-F.col("first_word")).alias("p"), "end_word")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", "x.matched", (-F.col("x.p")).alias("first_word"), "x.end_word")


def _by_shuffle(docs: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides are joined, then the texts of the pairs that meet."""

    def each(batches: Iterator[pa.RecordBatch], of_items: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = text_bytes(batch.column(1))
            for a, b in slices(np.diff(offsets)):
                words, _, _, rows = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], PLAIN)
                for mask in masks_of(min_words):
                    at, h = item_seeds(words, rows, mask, b - a) if of_items else seeds(words, rows, mask)
                    pairs = np.unique(np.stack([h.view(np.int64), ids[a:b][rows[at]]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["h", "id"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, item_id, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "passage")), strict=True):
                bench = Bench([(item_id, passage)], min_words)
                raw, offsets = text_bytes(pa.array([text]))
                words, _, _, rows = word_hashes(raw, offsets, PLAIN)
                out.append(_rows(np.array([doc_id]), bench, bench.verify(words, np.array([0, len(words)]), bench.hits(words, rows))))
            yield from out

    # Of a seed that a third of the documents hold, both joins' sides may be split: distinct pairs are made behind them.
    of_docs = docs.select("doc_id", "text").mapInArrow(lambda x: each(x, False), "h long, id long").select("h", F.col("id").alias("doc_id"))
    of_items = items.select("item_id", "text").mapInArrow(lambda x: each(x, True), "h long, id long").select("h", F.col("id").alias("item_id")).distinct()
    pairs = of_docs.join(of_items, "h").select("doc_id", "item_id").distinct()
    texts = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "passage"), "item_id")
    return _best(texts.select("doc_id", "text", "item_id", "passage").mapInArrow(check, COLUMNS))


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no passage with the benchmark, with their own columns."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
