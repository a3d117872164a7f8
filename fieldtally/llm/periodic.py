"""Runs of periodic words by Crochemore's partition refinement.

Positions of a text are put in classes of equal factors, for factors of one word, then two, and so on. A class of the next
length is what is left of one of this length when positions are told apart by the class of the place behind them; and of
the parts into which a class fell, all but the largest are enough to tell (a position moves only as part of a smaller
half, so log n times at most). Two neighbours in a class at the distance of its length are a square with a root that is
no power; squares of one root length that stand side by side are one run.

Before that, a text is cut to the stretches in which every factor of a few words also stands elsewhere in the text: a
run of the wanted length lies within one such stretch whole, and most texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldtally.llm.common import documents, mix, slices, text_bytes

#: Words of a run at least, and how often it holds its period at least.
LEAST, EXPONENT = 24, 3
#: Bytes of texts in a batch of results.
STEP = 4 << 20


def factor_length(least: int, exponent: int) -> int:
    """So many words that every factor of so many within a run also stands a period before or behind it in the run."""
    return max(1, min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2)))


def stretches(words: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of at least `least` words whose factors of k words all stand elsewhere too, by their
    hashes (a hash that two factors share makes a stretch longer, and no run is lost by that). words: small integers."""
    n = len(words) - k + 1
    if n < 2:
        return []
    named, rolled = mix(words.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for i in range(k):
        rolled = mix(rolled + named[i : i + n])
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edge = np.diff(again)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + k - 1
    return [(a, b) for a, b in zip(starts.tolist(), stops.tolist(), strict=True) if b - a >= least]


class Partition:
    """Classes of positions as linked lists in order, and for each distance the positions that are followed in their class
    at that distance."""

    def __init__(self, n: int, farthest: int):
        self.farthest = farthest
        self.of, self.before, self.after = [-1] * n, [-1] * n, [-1] * n
        self.first: list[int] = []
        self.last: list[int] = []
        self.size: list[int] = []
        self.apart: dict[int, set[int]] = {}

    def new(self) -> int:
        self.first.append(-1)
        self.last.append(-1)
        self.size.append(0)
        return len(self.size) - 1

    def link(self, i: int, j: int) -> None:
        if 0 <= i and 0 <= j and j - i <= self.farthest:
            self.apart.setdefault(j - i, set()).add(i)

    def unlink(self, i: int, j: int) -> None:
        if 0 <= i and 0 <= j and j - i <= self.farthest:
            there = self.apart[j - i]
            there.discard(i)
            if not there:
                del self.apart[j - i]

    def take(self, i: int) -> None:
        """Takes a position out of its class."""
        c, a, b = self.of[i], self.before[i], self.after[i]
        self.unlink(a, i)
        self.unlink(i, b)
        self.link(a, b)
        if a >= 0:
            self.after[a] = b
        else:
            self.first[c] = b
        if b >= 0:
            self.before[b] = a
        else:
            self.last[c] = a
        self.size[c] -= 1

    def put(self, c: int, i: int) -> None:
        """Puts a position at the end of a class."""
        a = self.last[c]
        self.of[i], self.before[i], self.after[i] = c, a, -1
        if a >= 0:
            self.after[a] = i
        else:
            self.first[c] = i
        self.last[c] = i
        self.size[c] += 1
        self.link(a, i)

    def places(self, c: int) -> list[int]:
        out, i = [], self.first[c]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out


def runs(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` words and `exponent` periods (two or more)."""
    n = len(words)
    most = n // exponent
    p, named = Partition(n, most), {}
    for i, word in enumerate(words):
        c = named.get(word)
        if c is None:
            c = named[word] = p.new()
        p.put(c, i)
    small = list(named.values())
    if small:
        small.remove(max(small, key=p.size.__getitem__))
    out = []
    for length in range(1, most + 1):
        if not p.apart:
            break
        squares = sorted(p.apart.get(length, ()))
        begin = 0
        for at in range(1, len(squares) + 1):
            if at == len(squares) or squares[at] != squares[at - 1] + 1:
                size = squares[at - 1] - squares[begin] + 2 * length
                if size >= max(least, exponent * length):
                    out.append((squares[begin], size, length))
                begin = at
        # classes of length + 1: a position goes by the class of the next one; the last has no longer factor
        halves = [p.places(c) for c in small]
        p.take(n - length)
        parts: dict[int, list[int]] = {}
        for half in halves:
            made: dict[int, int] = {}
            for i in half:
                i -= 1
                if i < 0:
                    continue
                c = p.of[i]
                if c not in made:
                    if p.size[c] < 2:
                        continue
                    made[c] = p.new()
                    parts.setdefault(c, []).append(made[c])
                p.take(i)
                p.put(made[c], i)
        small = []
        for c, fresh in parts.items():
            group = [*fresh, c] if p.size[c] else fresh
            group.remove(max(group, key=p.size.__getitem__))
            small += group
    return sorted(out)


def text_runs(words: list[bytes], least: int, exponent: int, k: int) -> list[tuple[int, int, int]]:
    """Runs of a text's words, sorted by start and period."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    if len(numbers) == len(words):
        return []
    found = [(start + a, length, q) for a, b in stretches(ids, k, least) for start, length, q in runs(ids[a:b].tolist(), least, exponent)]
    return sorted((start, length, q) for start, length, q in found)


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words, of each run only its first period, joined by blanks."""
    if not found:
        return b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]).decode()


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """For every document: doc_id; runs, an array of (start, length, period) in words from 0, sorted by start and period;
    and collapsed, the text's words joined by single blanks without those that repeat a run's first period.

    Words are what stands between ASCII white space. A null text is empty: no runs, nothing left. Repeated rows, and rows
    without a doc_id, are taken each for itself. An empty table gives no rows. Other columns are not looked at."""
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    k = factor_length(least, exponent)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in slices(np.diff(offsets), STEP):
                found, texts = [], []
                for i in range(a, b):
                    words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
                    found.append(text_runs(words, least, exponent, k))
                    texts.append(collapse(words, found[-1]))
                starts, lengths, periods = (pa.array([r[c] for x in found for r in x], pa.int64()) for c in range(3))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([starts, lengths, periods], fields=list(run)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return documents(docs).mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
