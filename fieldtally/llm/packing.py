"""Best-fit packing of token sequences, after a dominance reduction.

Pieces of equal length are alike, so the packing is worked out on the histogram of lengths: at most `capacity` numbers,
whatever the corpus. The reduction fixes small sets of pieces that provably serve as well as any other set with the same
piece (after Martello and Toth), the rest is packed best-fit decreasing, many like bins at a time. The plan, ranges of
ranks within each length, is small too; Spark ranks the pieces of each length, in salted parts, and looks their places
up. No text or list of pieces passes through the driver or a single task.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import documents, materialize

CAPACITY = 2048
#: Pieces of one length that are ranked together; more are ranked in so many parts.
RANKED_TOGETHER = 500
#: Texts whose pieces a task remembers, for copies that follow.
REMEMBERED = 4096


class Encoder:
    """Token ids of texts as the tokenizers library gives them. The same vocabulary as ranks gives the same ids several
    times faster; texts with a special token's string go to the library itself."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[tuple, Encoder] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, ranks_path)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(*key))
        seen: OrderedDict[tuple, list] = OrderedDict()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                digest = (len(text), hash(text), text[:32])
                got = seen.get(digest)
                if got is None:
                    ids = np.array([*encoder.ids(text), 0], "<u4")
                    got = [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), capacity))]
                    seen[digest] = got
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                out += [(doc_id.as_py(), *x) for x in got]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes bins that dominate every other bin with the same largest considered piece; takes them from counts.

    For a piece of length w with room r left beside it, the bin is fixed when: nothing else fits; a piece fills r
    exactly; two more never fit, then the longest that fits; or three more never fit and the longest that fits together
    with the longest that still fits beside that bounds both parts of any pair."""
    fixed = []

    def longest(room: int, used: tuple[int, ...]) -> int:
        for x in range(min(room, capacity), 0, -1):
            if counts[x] > used.count(x):
                return x
        return 0

    def smallest(k: int, used: tuple[int, ...]) -> int:
        total, left = 0, k
        for x in np.flatnonzero(counts):
            take = min(left, int(counts[x]) - used.count(int(x)))
            total, left = total + take * int(x), left - take
            if not left:
                return total
        return capacity + 1

    for w in range(capacity, 0, -1):
        while counts[w]:
            room = capacity - w
            best = longest(room, (w,))
            if not best:
                bin_ = (w,)
            elif best == room or smallest(2, (w,)) > room:
                bin_ = (w, best)
            else:
                second = longest(room - best, (w, best))
                if smallest(3, (w,)) > room and second and second >= longest(room // 2, (w,)):
                    bin_ = (w, best, second)
                else:
                    break
            times = min(int(counts[x]) // bin_.count(x) for x in set(bin_))
            fixed.append((bin_, times))
            for x in bin_:
                counts[x] -= times
    return fixed


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, with like bins filled together: a bin that takes a piece is the tightest for the next like
    piece as long as that fits, so each takes as many as fit before another is tried."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            room = next((r for r in range(w, capacity + 1) if by_room.get(r)), None)
            if room is None:
                room, bin_, times = capacity, (), -(-left // (capacity // w))
            else:
                bin_, times = by_room[room].pop()
            each = room // w
            full = min(times, left // each)
            if full:
                by_room.setdefault(room - each * w, []).append((bin_ + (w,) * each, full))
                left -= full * each
                times -= full
            if times and 0 < left < each:
                by_room.setdefault(room - left * w, []).append((bin_ + (w,) * left, 1))
                times, left = times - 1, 0
            if times and bin_:
                by_room.setdefault(room, []).append((bin_, times))
        counts[w] = 0
    return [x for group in by_room.values() for x in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) for counts[length] pieces of each length."""
    left = counts.astype(np.int64).copy()
    return reduce_dominated(left, capacity) + best_fit_decreasing(left, capacity)


def places(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of ranks: of the pieces of a length, those from rank on go to sequence, sequence + 1, ... at offset."""
    rows, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for bin_, times in bins:
        offset = 0
        for w in bin_:
            rows.append((w, used[w], sequence, offset))
            used[w] += times
            offset += w
        sequence += times
    table = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of lengths from 1 to capacity."""
    histogram = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():  # capacity rows at most
        histogram[row["length"]] = row["count"]
    held = parts.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    n_parts = F.split(F.lit(",".join(str(-(-int(n) // RANKED_TOGETHER)) for n in histogram)), ",").cast("array<int>")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.greatest(F.lit(1), F.get(n_parts, F.col("length").cast("int")))).cast("int"))
    group = salted.groupBy("length", "salt").count()
    before = group.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    in_part = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(in_part)).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(table["key"], (length << 48) + rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null or empty text is one piece of one token. Repeated rows are pieces of their own; ties in rank go by
    doc_id, piece, start and checksum. An empty table gives no rows. ranks_path: the tokenizer's vocabulary as ranks."""
    return pack(materialize(pieces(docs, tokenizer_path, ranks_path, capacity)), capacity)
