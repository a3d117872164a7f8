"""Retention: what a full buffer gives up, and the gaps that say so."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldtally.operators.small import beside


def gap_summary(discarded: DataFrame, reason: str, *keys: str) -> DataFrame:
    """One gap for each sensor and boot (and key): bounds in monotonic time, exact count, place of the first (first_id)."""
    return discarded.groupBy(*keys, "sensor_id", "boot_id").agg(
        F.min("mono_ns").alias("from_mono_ns"), F.max("mono_ns").alias("to_mono_ns"), F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_id")
    ).withColumn("reason", F.lit(reason))


def _parts(rows: DataFrame, by: str, descending: bool, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows with the part (`_part`) of the seq range that each is in, and of each buffer's parts how many rows they have
    (`_n`) and how many come before them (`_before`): one row for each part."""
    marked = rows.withColumn("_part", F.floor(F.col("seq") / part_rows))
    parts = marked.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sums = Window.partitionBy(by).orderBy(F.col("_part").desc() if descending else F.col("_part").asc())
    return marked, parts.select(by, "_part", "_n", (F.sum("_n").over(sums) - F.col("_n")).alias("_before"))


def _ranked(marked: DataFrame, by: str, descending: bool, ties: str) -> DataFrame:
    order = F.col("seq").desc() if descending else F.col("seq").asc()
    return marked.withColumn("nth", F.row_number().over(Window.partitionBy(by, "_part").orderBy(order, ties)) + F.col("_before"))


def with_rank(rows: DataFrame, by: str = "buffer_id", descending: bool = False, part_rows: int = 1_000_000, ties: str = "seq") -> DataFrame:
    """Adds `nth`, the place of each row in its buffer by seq (then by `ties`), from 1.

    Ranks within parts of the seq range plus the rows of the parts before, so that one buffer of many rows is ranked by
    many tasks."""
    marked, parts = _parts(rows, by, descending, part_rows)
    return _ranked(marked.join(parts.drop("_n"), [by, "_part"]), by, descending, ties).drop("_part", "_before")


def _limits(parts: DataFrame, k: int | DataFrame, by: str) -> DataFrame:
    """The parts with how many rows of their buffer are wanted (`_k`): k, or by buffer the column `over` of k (0 where absent)."""
    if isinstance(k, int):
        return parts.withColumn("_k", F.lit(k).cast("long"))
    return parts.join(k.select(by, F.col("over").alias("_k")), by, "left").na.fill(0, ["_k"])


def top(rows: DataFrame, k: int | DataFrame, by: str = "buffer_id", descending: bool = False, part_rows: int = 1_000_000, ties: str = "seq") -> DataFrame:
    """The first k rows of each buffer by seq, with their place `nth`. The counts of parts tell which parts can hold them:
    only those are ranked."""
    marked, parts = _parts(rows, by, descending, part_rows)
    wanted = _limits(parts, k, by).where("_before < _k").drop("_n")
    return _ranked(marked.join(wanted, [by, "_part"]), by, descending, ties).where("nth <= _k").drop("_part", "_before", "_k")


def beyond(rows: DataFrame, k: int | DataFrame, by: str = "buffer_id", descending: bool = False, part_rows: int = 1_000_000, ties: str = "seq") -> DataFrame:
    """All but the first k rows of each buffer by seq. Parts behind the k-th row pass as they are: only the one that holds
    it is ranked."""
    marked, parts = _parts(rows, by, descending, part_rows)
    limits = _limits(parts, k, by).where("_before + _n > _k")
    whole = marked.join(limits.where("_before >= _k").select(by, "_part"), [by, "_part"], "left_semi").select(rows.columns)
    cut = _ranked(marked.join(limits.where("_before < _k").drop("_n"), [by, "_part"]), by, descending, ties).where("nth > _k").select(rows.columns)
    return whole.unionByName(cut)


def survivors(readings: DataFrame, cap: int) -> DataFrame:
    """What a buffer that drops its oldest holds after appends only: the newest `cap` rows."""
    return top(readings, cap, descending=True).drop("nth")


def evicted(readings: DataFrame, cap: int) -> DataFrame:
    return beyond(readings, cap, descending=True)


def total_order(rows: DataFrame, by: str = "buffer_id") -> DataFrame:
    """Rows sorted by buffer and seq with their place from 1: the place in the buffer plus the rows of the buffers before,
    of which one row each is windowed."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(by, (F.sum("_n").over(Window.orderBy(by)) - F.col("_n")).alias("_ahead"))
    placed = with_rank(rows, by).join(before, by).withColumn("place", F.col("nth") + F.col("_ahead"))
    return placed.drop("nth", "_ahead").orderBy(by, "seq")


def _taken(used: int, n: int | None, freed: int | None, cap: int) -> tuple[int, bool | None]:
    """The rows in use after a batch of n that finds `freed` more acknowledged, and whether it was taken."""
    used = 0 if freed is None else max(0, used - freed)
    fits = None if n is None else used + n <= cap
    return (used + n if fits else used), fits


class HaltMap:
    """Some batches in order as one map of the rows in use, from those before them to those after: pieces (lo, out, slope)
    in which the latter stay as they are (0) or grow with the former (1). Once every piece stays, its distinct values are
    led on; they soon are one, as buffers that hold the same go on alike."""

    def __init__(self, cap: int):
        self.cap, self.end = cap, max(cap, 0) + 1
        self.lo, self.out, self.slope = np.array([0]), np.array([0]), np.array([1])
        self.values = self.of = None

    def _cut(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Cuts each piece behind its first `at` inputs; tells which pieces are first halves."""
        width = np.concatenate([at, width - at])
        keep = np.flatnonzero(width > 0)
        lo = np.concatenate([self.lo, self.lo + at])[keep]
        order = np.argsort(lo)
        self.out = np.concatenate([self.out, self.out + self.slope * at])[keep][order]
        self.slope = np.where(width == 1, 0, np.concatenate([self.slope, self.slope]))[keep][order]
        self.lo = lo[order]
        return (keep < len(at))[order]

    def _below(self, bound: int) -> np.ndarray:
        """Cuts the pieces where their values reach the bound; tells which are below."""
        width = np.append(self.lo[1:], self.end) - self.lo
        return self._cut(np.where(self.slope == 1, np.clip(bound - self.out, 0, width), np.where(self.out < bound, width, 0)), width)

    def then(self, n: int | None, freed: int | None) -> None:
        """n, freed: of the next batch, not negative."""
        if self.values is not None:
            if len(self.values) == 1:
                self.values[0] = _taken(int(self.values[0]), n, freed, self.cap)[0]
                return
            v = self.values * 0 if freed is None else np.maximum(self.values - freed, 0)
            v = v if n is None else np.where(v + n <= self.cap, v + n, v)
            self.values, again = np.unique(v, return_inverse=True)
            self.of = again[self.of]
            return
        if freed is None:
            self.out, self.slope = self.out * 0, self.slope * 0
        elif freed:
            none = self._below(freed)
            self.out, self.slope = np.where(none, 0, self.out - freed), np.where(none, 0, self.slope)
        if n:
            self.out = np.where(self._below(self.cap - n + 1), self.out + n, self.out)
        width = np.append(self.lo[1:], self.end) - self.lo
        on = (self.slope[1:] == self.slope[:-1]) & (self.out[1:] == self.out[:-1] + self.slope[:-1] * width[:-1])
        keep = np.append(True, ~on)
        self.lo, self.out, self.slope = self.lo[keep], self.out[keep], self.slope[keep]
        if not self.slope.any():
            self.values, self.of = np.unique(self.out, return_inverse=True)

    def pieces(self) -> list[tuple[int, int, int]]:
        out = self.out if self.values is None else self.values[self.of]
        keep = np.append(True, (out[1:] != out[:-1]) | (self.slope[1:] != 0) | (self.slope[:-1] != 0))
        return list(zip(self.lo[keep].tolist(), out[keep].tolist(), self.slope[keep].tolist(), strict=True))


def _maps(batches: Iterator[tuple[int | None, int | None]], cap: int, most: int) -> Iterator[tuple[int, int | None, int | None, int]]:
    """(sub, lo, out, slope) of the batches (n, freed) of a part. A map of more than `most` pieces ends, and another one goes
    on behind it; one that has more pieces than batches is given as these: (sub, n, freed, -1). So never more rows
    come out than went in."""
    sub, part, seen, count = 0, HaltMap(cap), [], 0

    def done() -> Iterator[tuple[int, int | None, int | None, int]]:
        pieces = part.pieces()
        if len(pieces) < count or len(seen) < count:
            yield from ((sub, *piece) for piece in pieces)
        else:
            yield from ((sub + i, n, freed, -1) for i, (n, freed) in enumerate(seen))

    for n, freed in batches:
        odd = (n or 0) < 0 or (freed or 0) < 0
        if count and (odd or len(part.lo) > most):
            yield from done()
            sub, part, seen, count = sub + count, HaltMap(cap), [], 0
        if odd:
            yield sub, n, freed, -1
            sub += 1
            continue
        part.then(n, freed)
        count += 1
        if len(seen) < 4 * most:
            seen.append((n, freed))
    if count:
        yield from done()


def halted_batches(batches: DataFrame, cap: int, part_batches: int | None = None, most: int = 4096) -> DataFrame:
    """A buffer that halts takes a batch only if it fits whole; a small one may fit after a large one was refused.
    batches: buffer_id, batch, n (and acked, rows that are acknowledged before it; 0 if absent).

    By default each buffer is folded by one task, a number kept of it: about a second for a million batches. With
    part_batches, and where a buffer spans more than one range of so many batch numbers, each range becomes a map of the rows in use (see HaltMap), the maps are composed in order, and
    every range is folded from what was in use before it, by a task of its own."""
    acked = F.col("acked") if "acked" in batches.columns else F.lit(0)
    ordered = batches.select("buffer_id", F.col("batch").cast("long").alias("batch"), F.col("n").cast("long").alias("n"), acked.cast("long").alias("acked"))
    ordered = ordered.withColumn("part", F.floor(F.col("batch") / part_batches) if part_batches else F.lit(0).cast("long"))
    kinds = ordered.select("buffer_id", "batch", "n", F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("long").alias("used")).schema
    ids = ordered.schema["buffer_id"].dataType
    id_type = to_arrow_type(ids)
    by = ["buffer_id", "part"]

    def rows_of(some: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
        return zip(*(some.column(c).to_pylist() for c in columns), strict=True)

    def maps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for some in rows for row in rows_of(some, *by, "n", "acked"))
        pieces = ((*key, *piece) for key, of in groupby(every, itemgetter(0, 1)) for piece in _maps(((n, freed) for _, _, n, freed in of), cap, most))
        while some := list(islice(pieces, 50_000)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else id_type) for i, c in enumerate(columns)], [*by, "sub", "lo", "out", "slope"])

    def compose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, part, sub, used, after = (), (), None, 0, 0
        for some in rows:
            first, came = [], []
            for i, (b, p, s, lo, out, slope) in enumerate(rows_of(some, *by, "sub", "lo", "out", "slope")):
                if buffer != (b,):
                    buffer, part, sub, used, after = (b,), (), None, 0, 0
                if part != (p,) or s != sub:
                    used = after
                    if part != (p,):
                        first.append(i)
                        came.append(used)
                    part, sub = (p,), s
                if slope < 0:
                    after = _taken(used, lo, out, cap)[0]
                elif lo <= used:
                    after = out + slope * (used - lo)
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("buffer_id").take(at), some.column("part").take(at), pa.array(came, pa.int64())], [*by, "came"])

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = (), 0
        for some in rows:
            accepted, after = [], []
            for buffer, part, came, n, freed in rows_of(some, *by, "came", "n", "acked"):
                used, fits = _taken(used if at == (buffer, part) else came, n, freed, cap)
                at = (buffer, part)
                accepted.append(fits)
                after.append(used)
            yield pa.RecordBatch.from_arrays([some.column("buffer_id"), some.column("batch"), some.column("n"), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], ["buffer_id", "batch", "n", "accepted", "used"])

    spans = ordered.groupBy("buffer_id").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count_if(F.col("part").isNull()).alias("none"))
    if part_batches and spans.where((F.col("a") != F.col("b")) | ((F.col("none") > 0) & F.col("a").isNotNull())).limit(1).count():
        pieces = ordered.repartition(*by).sortWithinPartitions(*by, "batch", "n", "acked").mapInArrow(maps, f"buffer_id {ids.simpleString()}, part long, sub long, lo long, out long, slope long")
        entries = pieces.repartition("buffer_id").sortWithinPartitions(*by, "sub", "lo").mapInArrow(compose, f"buffer_id {ids.simpleString()}, part long, came long")
        few = beside(entries.withColumnsRenamed({"buffer_id": "_b", "part": "_p"}))
        started = ordered.join(few, F.col("buffer_id").eqNullSafe(F.col("_b")) & F.col("part").eqNullSafe(F.col("_p"))).drop("_b", "_p").repartition(*by)
    else:
        started = ordered.withColumns({"part": F.lit(0).cast("long"), "came": F.lit(0).cast("long")}).repartition("buffer_id")
    return started.sortWithinPartitions(*by, "batch", "n", "acked").mapInArrow(fold, kinds)


def seal_epochs(discards: DataFrame, seals: DataFrame, part_rows: int = 1_000_000) -> DataFrame:
    """Gaps merged until a seal freezes them: discards and seals of a (buffer, sensor, boot, reason) in the order of pos;
    each seal that follows a discard closes the open gap. discards: ..., pos, mono_ns; seals: ..., pos.

    A group of up to part_rows rows is looked through by one task. If there is a larger one, seals are counted within parts of the range
    of pos plus those of the parts before, so that it is looked through by many."""
    keys = ["buffer_id", "sensor_id", "boot_id", "reason"]
    both = discards.select(*keys, "pos", "mono_ns", F.lit(0).alias("seal")).unionByName(seals.select(*keys, "pos", F.lit(None).cast("long").alias("mono_ns"), F.lit(1).alias("seal")))
    largest = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    sealed = lambda rows, epoch: rows.withColumn("epoch", epoch).where("seal = 0").groupBy(*keys, "epoch").agg(F.min("mono_ns").alias("from_mono_ns"), F.max("mono_ns").alias("to_mono_ns"), F.count(F.lit(1)).alias("count"))
    if largest <= part_rows:
        earlier = Window.partitionBy(*keys).orderBy("pos", "seal").rowsBetween(Window.unboundedPreceding, -1)
        return sealed(both, F.coalesce(F.sum("seal").over(earlier), F.lit(0)))
    both = both.withColumn("_part", F.floor(F.col("pos") / part_rows))
    parts = both.groupBy(*keys, "_part").agg(F.sum("seal").alias("_s"))
    before = parts.select(*keys, "_part", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_s")).alias("_before"))
    at = Window.partitionBy(*keys, "_part").orderBy("pos", "seal").rowsBetween(Window.unboundedPreceding, -1)
    return sealed(both.join(before, [*keys, "_part"]), F.coalesce(F.sum("seal").over(at), F.lit(0)) + F.col("_before"))


def next_commits(t: np.ndarray, known: np.ndarray, max_rows: int, max_delay: int) -> np.ndarray:
    """For a commit at each row, the row of the next one; beyond the last row where it isn't among them."""
    n = len(t)
    out, open_ = np.arange(n) + max_rows, np.ones(n, bool)
    for d in range(1, min(max_rows, n)):
        hit = np.flatnonzero(open_[: n - d] & (~known[: n - d] | (known[d:] & (t[d:] - t[: n - d] >= max_delay))))
        out[hit], open_[hit] = hit + d, False
    return out


def flushes(writes: DataFrame, max_rows: int, max_delay: int, part_rows: int = 100_000) -> DataFrame:
    """Commits of a batcher: after a write, when so many are pending or so long has passed since the last commit (the
    first write commits alone). writes: buffer_id, pos (neither null), t. Rows: buffer_id, pos of the committing write, n.

    A buffer is cut into parts of its ranks. The last commit before a part is one of the max_rows writes before it, so a
    part is a map from these to its own last commit. The maps are composed in order, then each part lists its commits."""
    max_rows = max(max_rows, 1)
    part_rows = max(part_rows, max_rows)
    ranked = with_rank(writes.select("buffer_id", F.col("pos").cast("long").alias("seq"), F.col("t").cast("long").alias("t")), ties="t")
    at = F.col("nth") - 1
    part = F.call_function("div", at, F.lit(part_rows))
    both = F.when(at % part_rows >= part_rows - max_rows, F.array(part, part + 1)).otherwise(F.array(part))
    parts = ranked.select("buffer_id", F.col("seq").alias("pos"), "t", F.col("nth").cast("long").alias("nth"), F.explode(both).alias("part"))
    buffer = writes.schema["buffer_id"].dataType.simpleString()

    def load(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Rank of the first row, positions, next commits, and how many rows stand before the part. Ahead of a buffer's
        first write comes a commit of no time."""
        table = table.sort_by("nth")
        first, k = table.column("nth")[0].as_py(), table.column("part")[0].as_py()
        pos, t = table.column("pos").to_numpy(), table.column("t").fill_null(0).to_numpy()
        known = table.column("t").is_valid().to_numpy()
        if k == 0:
            first, pos, t, known = 0, np.append(0, pos), np.append(0, t), np.append(False, known)
        return first, pos, next_commits(t, known, max_rows, max_delay), k * part_rows - first + 1

    def ends(table: pa.Table) -> pa.Table:
        first, pos, after, before = load(table)
        last = list(range(len(pos)))
        for j in range(len(pos) - 1, -1, -1):
            if after[j] < len(pos):
                last[j] = last[after[j]]
        n = before if before < len(pos) else 0
        return pa.table({"buffer_id": table.column("buffer_id").combine_chunks().slice(0, 1).take(pa.array([0] * n, pa.int64())), "part": pa.array([table.column("part")[0].as_py()] * n, pa.int64()), "came": pa.array([first + j for j in range(n)], pa.int64()), "left": pa.array([first + j for j in last[:n]], pa.int64())})

    def compose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, came = (), 0, 0
        for some in rows:
            hit = []
            for i, (b, p, x, y) in enumerate(zip(*(some.column(c).to_pylist() for c in ("buffer_id", "part", "came", "left")), strict=True)):
                if at != (b,):
                    at, k, came = (b,), 0, 0
                if p == k and x == came:
                    hit.append(i)
                    k, came = k + 1, y
            yield some.take(pa.array(hit, pa.int64())).select(["buffer_id", "part", "came"])

    def commits(table: pa.Table) -> pa.Table:
        first, pos, after, _ = load(table)
        j, found, n = table.column("came")[0].as_py() - first, [], []
        while after[j] < len(pos):
            n.append(int(after[j]) - j)
            j = int(after[j])
            found.append(j)
        return pa.table({"buffer_id": table.column("buffer_id").combine_chunks().take(pa.array([0] * len(n), pa.int64())), "pos": pa.array(pos[found].astype(np.int64)), "n": pa.array(n, pa.int64())})

    maps = parts.groupBy("buffer_id", "part").applyInArrow(ends, f"buffer_id {buffer}, part long, came long, left long")
    entries = maps.repartition("buffer_id").sortWithinPartitions("buffer_id", "part", "came").mapInArrow(compose, f"buffer_id {buffer}, part long, came long")
    return parts.join(entries, ["buffer_id", "part"]).groupBy("buffer_id", "part").applyInArrow(commits, f"buffer_id {buffer}, pos long, n long")


def seq_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Sequence numbers as a block allocator gives them: contiguous in a run, a new run begins a new block. runs:
    buffer_id, run, n (numbers taken). Rows: buffer_id, run, first_seq, last_seq, next_block."""
    used = F.ceil(F.col("n") / block) * block
    at = Window.partitionBy("buffer_id").orderBy("run")
    first = F.sum(used).over(at) - used
    return runs.select("buffer_id", "run", first.cast("long").alias("first_seq"), (first + F.col("n") - 1).cast("long").alias("last_seq"), (first + used).cast("long").alias("next_block"))
