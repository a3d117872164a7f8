"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a list of 64-bit ids is broadcast; longer lists are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes (written as JSON) up to which such a list, or another small table, is broadcast.
BROADCAST_BYTES = 64 << 20
#: Groups of more than this part of all rows are hot: they are broadcast, being fewer than so many.
HOT = 1000
#: Text bytes that a numpy step takes at once; a longer document makes a step of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on
    one machine; on a cluster it must be set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="fieldtally-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and no executor's loss recomputes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldtally/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long and text as string, beside the named columns: whatever else the table has stays out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ids; ids are broadcast while their number is small, else both are shuffled."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df may be broadcast, by its rows and by their bytes. Read for it, so written before."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and held <= size


def beside_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """rows with the columns of their group (all but `count`, null where there is none), as a left join on keys. groups: a
    row for each key, with the number of rows of it in `count`; read twice, so written before.

    Groups of more than a HOT part of all counted rows are broadcast: there are fewer than HOT of them. The rest are
    joined by shuffling, where rows of hot groups are spread out by `spread`."""
    most = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    rest = [c for c in groups.columns if c not in (*keys, count)]
    hot = groups.where(F.col(count) * HOT > most).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*rest).alias("_hot"))
    other = groups.where(F.col(count) * HOT <= most).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.struct(*rest).alias("_other"))
    marked = rows.join(F.broadcast(hot), reduce(Column.__and__, [F.col(k) == F.col(f"_hot_{k}") for k in keys]), "left")
    is_hot = F.col(f"_hot_{keys[0]}").isNotNull()
    # the first key of a hot row becomes a hash of `spread`, and one more condition sees that it meets nothing
    first = F.when(is_hot, F.xxhash64(spread).cast(rows.schema[keys[0]].dataType)).otherwise(F.col(keys[0])) == F.col(f"_of_{keys[0]}")
    cold = F.when(is_hot, 1).otherwise(0) == F.lit(0)
    joined = marked.join(other, reduce(Column.__and__, [first, cold, *[F.col(k) == F.col(f"_of_{k}") for k in keys[1:]]]), "left")
    both = F.when(is_hot, F.col("_hot")).otherwise(F.col("_other"))
    return joined.select(*rows.columns, *[both[c].alias(c) for c in rest])


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about `most` bytes each."""
    ends = np.cumsum(lengths)
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], (offsets - offsets[0]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply, the usual finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Multipliers of joined hashes, by family; and masks of the first bytes of eight.
JOIN = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes from which a span is hashed by itself rather than beside others.
LONG_SPAN = 1024


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one integer; zeros behind the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded.data, 0, 1)


def join(a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of two hashes in order. Shifts stand between the multiplications: a sum of multiples alone has texts (of the
    Thue-Morse kind) that collide modulo 2 ** 64 whatever the multiplier."""
    first, second = (np.uint64(x) for x in JOIN[family])
    x = a * first
    x ^= x >> np.uint64(32)
    x += b
    x *= second
    x ^= x >> np.uint64(29)
    return x


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes raw[start:end], equal for equal spans wherever they stand: joined eight by eight."""
    left = np.asarray(ends - starts, np.int64)
    h, row, at, eight = mix(left.astype(np.uint64) + np.uint64(1)), np.arange(len(left)), np.asarray(starts, np.int64), eights(raw)
    long = left > LONG_SPAN
    for i in np.flatnonzero(long).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + left[i]].tobytes(), seed=int(h[i]))
    row, at, left = row[~long], at[~long], left[~long]
    while len(row):
        h[row] = join(h[row], eight[at] & FIRST_BYTES[np.minimum(left, 8)])
        on = left > 8
        row, at, left = row[on], at[on] + 8, left[on] - 8
    return mix(h)


def window_hash(raw: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hashes of the `width` bytes from every place that has so many: those of 8, 16, 32 bytes and so on, joined."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    h, size = (eights(raw)[: len(raw) - 7].copy(), 8) if width >= 8 else (raw.astype(np.uint64), 1)
    while 2 * size <= width:
        h, size = join(h[:-size], h[size:], family), 2 * size
    if size < width:
        h = join(h[: size - width], h[width - size :], family)
    return mix(h)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes of words of letters, digits and all that is not ASCII.
PLAIN = np.ones(256, bool)
PLAIN[:128] = [chr(c).isalnum() for c in range(128)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte, end byte and row of every word: maximal runs of the bytes that `inside` allows, A-Z lower-cased, never over a row's end."""
    n = len(raw)
    ok = inside[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = ok[:-1]
    starts = np.flatnonzero(ok & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = ok[1:]
    ends = np.flatnonzero(ok & (~after | cut[1:])) + 1
    hashes = span_hash(LOWER[raw], starts, ends)
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def unsigned_to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
