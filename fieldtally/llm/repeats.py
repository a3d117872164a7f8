"""Substring deduplication by maximal repeats of an enhanced suffix array.

1. Equal texts are one from there on; all but the first document of each are removed whole.
2. Anchors: of every LENGTH bytes in a row, the place whose K bytes hash smallest. Equal strings of LENGTH bytes have
   their anchor at the same place, so only anchors whose K bytes occur twice can lie in a repeat. Spark finds them.
3. Around those anchors, contexts are cut: the bytes of the windows that belong to the anchor. Spark groups them by the
   anchor's bytes; strings that repeat meet in one group.
4. In a group (one of more than LARGE bytes is taken apart into its windows instead, see windows_again): the suffixes that share LENGTH bytes with another are sorted (hash of the first LENGTH bytes, then the
   bytes behind), with their common prefixes. A stack scan walks the intervals of common prefixes; those whose
   occurrences are preceded by different bytes are maximal repeats, with all their occurrences. All occurrences but the
   earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import beside_counted, documents, materialize, mix, only_ids, slices, text_bytes, window_hash

LENGTH = 100
#: Bytes of an anchor.
K = 40
#: Context bytes that a step of the group scan takes; a larger group makes a step of its own.
STEP = 1 << 20
#: Text bytes that are hashed at once, few enough for a processor's cache; and those of a long text whose contexts are cut
#: at once.
SLICE, CUT = 1 << 19, 1 << 16
#: Places whose neighbours are looked at together.
NEAR = 1 << 14
#: Contexts, covered ones included, that a step of the group scan takes.
MANY = 100_000
#: Bytes of distinct contexts of one anchor that a task holds; a larger group is taken apart into its windows.
LARGE = 4 << 20
#: Anchors that are looked through together for those that repeat.
TOGETHER = 150_000


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + width], for every i; shorter at the end."""
    f, out, step = (np.minimum if least else np.maximum), x.copy(), 1
    while step < width:
        more = min(step, width - step)
        if more < len(out):
            out[:-more] = f(out[:-more], out[more:])
        step += more
    return out


def place_hashes(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k bytes from each place, and its upper half, by which the smallest is chosen; the last k - 1 places
    have the greatest."""
    full = np.full(len(raw), np.iinfo(np.uint64).max, np.uint64)
    full[: max(0, len(raw) - k + 1)] = window_hash(raw, k)
    return full, (full >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all rows, and the hashes of their k bytes: places that some window of `length` bytes has
    for its smallest. Of equal ones in a window all are anchors."""
    n, width = len(raw), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full, order = place_hashes(raw, length, k)
    least = sliding(order, width, True)
    for end in offsets[1:].tolist():  # windows that would cross a row's end
        least[max(0, end - length + 1) : end] = 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a < length:
            least[a:b] = 0
    back = sliding(least[::-1], width, False)[::-1]
    places = np.flatnonzero(back == order)
    return places, full[places]


def windows_of(places: np.ndarray, raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window (by its start) that has each place for its leftmost smallest; none where last < first."""
    width = length - k + 1
    _, order = place_hashes(raw, length, k)
    order = np.concatenate([np.zeros(width, np.uint32), order, np.zeros(width, np.uint32)])
    step = np.arange(1, width)
    back, ahead = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    for at in range(0, len(places), NEAR):
        here = places[at : at + NEAR] + width
        own = order[here][:, None]
        before, after = order[here[:, None] - step] <= own, order[here[:, None] + step] < own
        back[at : at + NEAR] = np.where(before.any(1), before.argmax(1), width - 1)
        ahead[at : at + NEAR] = np.where(after.any(1), after.argmax(1), width - 1)
    row = np.searchsorted(offsets, places, "right") - 1
    first = np.maximum(places - back, offsets[row])
    last = np.minimum(np.minimum(places, places + ahead + 1 - width), offsets[row + 1] - length)
    return first, last


def parts_of(offsets: np.ndarray, most: int, before: int, behind: int, long: int | None = None) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Parts of a batch's texts: rows a to b, the bytes from x to y that are looked at, and of these the bytes from p to q
    that are this part's own. Several short rows are one part; a row of more than `most` bytes is taken in parts of `long`
    (`most` by default) that see so many bytes before and behind their own."""
    for a, b in slices(np.diff(offsets), most):
        start, end = int(offsets[a]), int(offsets[b])
        if end - start <= most:
            yield a, b, start, end, start, end
            continue
        for p in range(start, end, long or most):
            q = min(p + (long or most), end)
            yield a, b, max(start, p - before), min(end, q + behind), p, q


def maximal_repeats(text: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of the maximal repeats of at least `length` bytes in rows text[bounds[i]:bounds[i + 1]], with
    all their starts. What precedes a row's first byte counts as different from everything."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(text)) + length <= ends)
    if len(starts) < 2:
        return
    hashes = window_hash(text, length)[starts]
    order = np.argsort(hashes, kind="stable")
    starts, hashes = starts[order], hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    # only classes of two or more, whose left bytes differ: no interval inside another class is left-diverse
    is_first = np.zeros(len(text) + 1, bool)
    is_first[bounds] = True
    left = np.where(is_first[starts], np.arange(len(starts)) + 256, text[np.maximum(starts, 1) - 1].astype(np.int64))
    cuts = np.flatnonzero(new)
    keep = ((size > 1) & (np.minimum.reduceat(left, cuts) != np.maximum.reduceat(left, cuts)))[group]
    starts, group, left = starts[keep], group[keep], left[keep]
    if not len(starts):
        return
    # the suffix array of what is left: by class, then by the bytes behind the first `length`
    tail = ends[starts] - starts - length
    wide = -(-int(tail.max() + 1) // 8) * 8
    padded = np.concatenate([text, np.zeros(wide + length, np.uint8)])
    behind = np.lib.stride_tricks.sliding_window_view(padded, wide)[starts + length]
    behind[np.arange(wide) >= tail[:, None]] = 0
    keys = behind.view(">u8").astype(np.uint64)
    order = np.lexsort((starts, tail, *keys.T[::-1], group))
    starts, group, left, tail, behind = starts[order], group[order], left[order], tail[order], behind[order]
    differ = behind[1:] != behind[:-1]
    same = np.where(differ.any(1), differ.argmax(1), wide)
    common = np.where(group[1:] == group[:-1], length + np.minimum(same, np.minimum(tail[1:], tail[:-1])), 0)
    # the interval tree, by a stack of (depth, first, least left byte, greatest left byte)
    stack: list[list[int]] = []
    for i, depth in enumerate([*common.tolist(), 0]):
        a, low, high = i, int(left[i]), int(left[i])
        while stack and stack[-1][0] > depth:
            d, a, l2, h2 = stack.pop()
            low, high = min(low, l2), max(high, h2)
            if low != high:
                yield d, starts[a : i + 1]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], low), max(stack[-1][3], high)
            else:
                stack.append([depth, a, low, high])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def text_key(text: bytes) -> int:
    """The first 64 bits of the text's sha256, as key_of has them in Spark."""
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)


def key_of(text: str) -> Column:
    return F.conv(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16), 16, -10).cast("long")


def known_twice(h: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an h that occurs twice here; and a salt, 0 for the first row of each h and spread out for others."""
    _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    salt = (mix(spread.view(np.uint64)) >> np.uint64(34)).astype(np.int32) + 1
    salt[first] = 0
    return (n > 1)[back], salt


def repeated_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, n, pos): anchors of distinct texts whose bytes occur elsewhere too, there or in another text."""

    names = ["h", "salt", "sure", "key", "n", "pos"]

    def rows_of(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        """An anchor that stands here twice is known to repeat: one of its rows goes where all tasks' rows of it meet, the
        others need no witness and are dealt at random."""
        h, key, n, pos = (np.concatenate(x) for x in out)
        sure, salt = known_twice(h, key ^ pos)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, salt, sure, key, n, pos)], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            out: list[list[np.ndarray]] = [[], [], [], []]
            last, fresh = None, None
            for a, b, x, y, p, q in parts_of(offsets, SLICE, 0, length - 1):
                if (a, b) != last:
                    last = (a, b)
                    keys = np.array([text_key(raw[i:j].tobytes()) for i, j in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)], np.int64)
                    named = list(zip(keys.tolist(), np.diff(offsets[a : b + 1]).tolist(), strict=True))
                    fresh = np.array([name not in done and not done.add(name) for name in named], bool)
                bounds = np.clip(offsets[a : b + 1], x, y)
                places, hashes = anchors(raw[x:y], bounds - x, length, k)
                rows = np.searchsorted(bounds - x, places, "right") - 1
                ok = fresh[rows]
                rows = rows[ok]
                for column, found in zip(out, (hashes[ok].view(np.int64), keys[rows], np.diff(offsets[a : b + 1])[rows].astype(np.int32), (places[ok] + x - offsets[a:b][rows]).astype(np.int32)), strict=True):
                    column.append(found)
                if sum(map(len, out[0])) > TOGETHER:
                    yield rows_of(out)
                    out = [[], [], [], []]
            if out[0]:
                yield rows_of(out)

    found = docs.where(F.octet_length("text") >= length).mapInArrow(find, "h long, salt int, sure boolean, key long, n int, pos int")
    same = Window.partitionBy("h", "salt")
    place = F.struct("key", "n", "pos")
    return found.select("sure", "key", "n", "pos", F.min(place).over(same).alias("lo"), F.max(place).over(same).alias("hi")).where("sure OR lo <> hi").select("key", "n", "pos").distinct()


def repeat_spans(docs: DataFrame, length: int = LENGTH, k: int = K, large: int = LARGE) -> DataFrame:
    """(doc_id, spans): of each document, the byte spans to remove, sorted and apart; documents without any are left
    out, and so are those that have the text of an earlier document. docs: doc_id, text, each doc_id once."""
    hit = repeated_anchors(docs, length, k)
    first = docs.groupBy(key_of("text").alias("key"), F.octet_length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"))
    at = materialize(hit.join(first, ["key", "n"]).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    texts = only_ids(docs, at.select("doc_id")).join(at, "doc_id")

    names = ["g", "salt", "doc_id", "start", "stop", "context"]

    def salted(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """A context that also stands earlier here is covered whole: it needs no group, and only its place goes on, in one
        span with those that it touches."""
        earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
        for g, doc, start, context in rows:
            earliest[g, context] = min(earliest.get((g, context), (doc, start)), (doc, start))
        kept, covered = [], {}
        for g, doc, start, context in rows:
            if earliest[g, context] == (doc, start):
                kept.append((g, 0, doc, start, start + len(context), context))
            else:
                covered.setdefault(doc, []).append((start, start + len(context)))
        kept += [(0, 1 + hash((doc, a)) % (1 << 30), doc, a, b, None) for doc, spans in covered.items() for a, b in merge(spans)]
        columns = list(zip(*kept, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = length + k
        for batch in batches:
            ids, (raw, offsets) = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
            wanted = batch.column("at")
            rows_out: list[tuple[int, int, int, bytes]] = []
            for a, b, x, y, p, q in parts_of(offsets, SLICE, margin, 2 * margin, CUT):
                at = np.concatenate([wanted[i].values.to_numpy(zero_copy_only=False) + offsets[i] for i in range(a, b)])
                at = at[(at >= p) & (at < q)]
                part, bounds = raw[x:y], np.clip(offsets[a : b + 1], x, y) - x
                first, last = windows_of(at - x, part, bounds, length, k)
                ok = last >= first
                at, first, last = at[ok] - x, first[ok], last[ok]
                rows = np.searchsorted(bounds, at, "right") - 1
                data = part.tobytes()
                for c, r, i, j in zip(at.tolist(), rows.tolist(), first.tolist(), last.tolist(), strict=True):
                    rows_out.append((xxhash.xxh3_64_intdigest(data[c : c + k]) >> 1, ids[a + r], x + i - int(offsets[a + r]), data[i : j + length]))
                if len(rows_out) > TOGETHER // 8:
                    yield salted(rows_out)
                    rows_out = []
            yield salted(rows_out)

    def spans_of(rows: list[tuple[int, int, int]], rest: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """Spans to remove, and contexts (with their start as a) of groups that are too large."""
        doc, a, b = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc + [x[0] for x in rest], pa.int64()), pa.array(a + [x[1] for x in rest], pa.int64()), pa.array(b + [None] * len(rest), pa.int64()), pa.array([None] * len(doc) + [x[2] for x in rest], pa.binary())],
            ["doc_id", "a", "b", "context"],
        )

    def solve(groups: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """groups: (doc_id, start, bytes) of distinct contexts."""
        ids, starts, data = zip(*groups, strict=True)
        out: dict[int, list[tuple[int, int]]] = {}
        bounds = np.cumsum([0, *map(len, data)])
        text = np.frombuffer(b"".join(data), np.uint8)
        doc, base = np.array(ids), np.array(starts)
        for depth, occurrences in maximal_repeats(text, bounds, length):
            rows = np.searchsorted(bounds, occurrences, "right") - 1
            place = base[rows] + occurrences - bounds[rows]
            order = np.lexsort((place, doc[rows]))
            here = doc[rows][order]
            d0, p0 = here[0], place[order[0]]
            for d, p in zip(here[1:].tolist(), place[order[1:]].tolist(), strict=True):
                if (d, p) != (d0, p0):
                    out.setdefault(d, []).append((p, p + depth))
        return spans_of([(d, x, y) for d, spans in out.items() for x, y in merge(spans)], [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, context and place: equal contexts stand together, the earliest first. The others of
        them are covered whole; the earliest of each are gathered until their group ends or grows too large."""
        groups: list[tuple[int, int, bytes]] = []
        covered: list[tuple[int, int, int]] = []
        rest: list[tuple[int, int, bytes]] = []
        size, own, begin, last = 0, 0, 0, (None, None)
        for batch in batches:
            for g, salt, doc, start, stop, x in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not salt and g != last[0]:
                    if size > STEP or len(groups) > MANY:
                        yield solve(groups)
                        groups, size = [], 0
                    own, begin = 0, len(groups)
                if salt or (g, x) == last:
                    covered.append((doc, start, stop))
                elif own > large:
                    rest.append((doc, start, x))
                else:
                    groups.append((doc, start, x))
                    size, own = size + len(x), own + len(x)
                    if own > large:
                        rest += groups[begin:]
                        del groups[begin:]
                        size -= own
                last = (g, x) if not salt else last
                if len(covered) + len(rest) > MANY:
                    yield spans_of(covered, rest)
                    covered, rest = [], []
        if groups:
            yield solve(groups)
        yield spans_of(covered, rest)

    cut = texts.select("doc_id", "text", "at").mapInArrow(contexts, "g long, salt int, doc_id long, start long, stop long, context binary")
    met = cut.repartition("g", "salt").sortWithinPartitions("g", "salt", "context", "doc_id", "start")
    found = materialize(met.mapInArrow(scan, "doc_id long, a long, b long, context binary"))
    spans, rest = found.where("context IS NULL").select("doc_id", "a", "b"), found.where("context IS NOT NULL")
    if not rest.isEmpty():
        spans = spans.unionByName(windows_again(rest.select("doc_id", F.col("a").alias("start"), "context"), length))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def windows_again(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, a, b): the windows of `length` bytes that also stand earlier in these contexts, one by one. Minima are
    aggregated before the shuffle, so no task holds a group. contexts: doc_id, start, context."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = (batch.column(c).to_numpy() for c in ("doc_id", "start"))
            raw, offsets = text_bytes(batch.column("context"))
            for a, b in slices(np.diff(offsets), SLICE // 8):
                part, bounds = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                at = np.flatnonzero(np.arange(len(part)) + length <= np.repeat(bounds[1:], np.diff(bounds)))
                row = np.searchsorted(bounds, at, "right") - 1
                h = [window_hash(part, length, family)[at].view(np.int64) for family in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ids[a:b][row]), pa.array(starts[a:b][row] + at - bounds[row])], ["h0", "h1", "doc_id", "pos"])

    rows = contexts.mapInArrow(each, "h0 long, h1 long, doc_id long, pos long")
    place = F.struct("doc_id", "pos")
    first = rows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h0", "h1", "first")
    again = rows.join(first, ["h0", "h1"]).where(place != F.col("first"))
    return again.select("doc_id", F.col("pos").alias("a"), (F.col("pos") + length).alias("b"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, large: int = LARGE) -> DataFrame:
    """For every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the remaining bytes, where any
    were removed (else null: the text as it is; empty for the whole copy of an earlier text).

    A null text is empty and keeps nothing. Texts under `length` bytes keep everything. Rows of equal doc_id and text
    are one document; rows whose doc_id is null are left out. An empty table gives no rows. Removing a part of a
    character leaves bytes that are no valid UTF-8, so kept is binary.
    """
    docs = documents(docs).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = materialize(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    spans = materialize(repeat_spans(docs, length, k, large))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            removed, number, shas, kept, whole = [], [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                data, out, at = raw[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                whole.append(hashlib.sha256(data).hexdigest())
                gone = merge([(x["a"], x["b"]) for x in spans])
                for a, b in gone:
                    out.append(data[at:a])
                    at = b
                rest = b"".join([*out, data[at:]])
                removed.append(len(data) - len(rest))
                number.append(len(gone))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.string()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "sha", "removed", "number", "cut_sha", "kept"])

    touched = only_ids(docs, spans.select("doc_id")).join(spans, "doc_id").select("doc_id", "text", "spans")
    cut = touched.mapInArrow(cut_out, "doc_id long, sha string, removed long, number long, cut_sha string, kept binary").dropDuplicates(["doc_id", "sha"])
    first = materialize(each.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= length)
    return (
        beside_counted(each, first, ["sha"], "copies", F.col("doc_id"))
        .join(cut, ["doc_id", "sha"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("number", F.lit(0).cast("long"))).alias("n_spans"),
            F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        )
    )
