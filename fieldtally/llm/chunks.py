"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes (each step shifts the hash by one bit and adds the next byte's value, so its 16
bits hold the last 16 bytes). A chunk ends where the hash is the greatest within REACH bytes on either side. That
depends on nearby bytes alone, so an insertion moves the boundaries near it and no others, and chunks are longer than
REACH bytes but the last. Chunks are deduplicated by digest: the earliest of each stays. A phrase that happens to fill a
chunk tells little, so only runs of adjoining repeated chunks of RUN bytes or more are removed, and whole texts of any
length that equal an earlier one. A last chunk of less than LEAST bytes goes with the chunk before it: it is repeated
where both end an earlier text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import documents, materialize, mix, only_ids, slices, text_bytes
from fieldtally.llm.repeats import merge, sliding

REACH = 19
#: Bytes from which a chunk is deduplicated for itself; a shorter last one is taken together with the chunk before it.
LEAST = 20
#: Bytes from which a run of repeated chunks is removed.
RUN = 100
GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
WINDOW = 16


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, by doubling: 1, 2, 4, 8, 16 bytes' worth."""
    h, step = GEAR[raw], 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h, step = more, step * 2
    return h


def boundaries(raw: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Ends of all chunks, rows' ends included. No chunk ends inside a character or crosses rows."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    starts_char = np.ones(n + 1, bool)
    starts_char[:n] = (raw & 0xC0) != 0x80
    h = gear_hashes(raw).astype(np.int32)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    into = np.arange(n) - offsets[own]
    h[~starts_char[1:] | (into < WINDOW)] = -1  # the hash still holds the row before
    top = sliding(h, reach, False)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    left[reach:] = top[: n - reach]
    right[:-1] = top[1:]
    cut = np.flatnonzero((h > left) & (h > right) & (h >= 0)) + 1
    return np.unique(np.concatenate([cut, offsets[1:]]))


def digest(data: bytes, kind: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def chunk_table(docs: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """doc_id, start, length and digest (two longs) of every chunk that may be deduplicated, and of every whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in slices(np.diff(offsets)):
                part, bounds = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ends = boundaries(part, bounds, reach)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
                rows, data = np.searchsorted(bounds, starts, "right") - 1, part.tobytes()
                ok = ends - starts >= least
                tail = ~ok & (ends == bounds[rows + 1]) & (starts > bounds[rows])
                reach_back = np.where(tail, np.concatenate([[0], starts[:-1]])[: len(starts)], starts)
                full = np.flatnonzero(np.diff(bounds))
                take = np.flatnonzero(ok | tail)
                found = [digest(data[x:y], b"tail" if t else b"") for x, y, t in zip(reach_back[take].tolist(), ends[take].tolist(), tail[take].tolist(), strict=True)]
                found += [digest(data[x:y], b"whole") for x, y in zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True)]
                digests = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                starts, ends = np.concatenate([starts[take], bounds[full]]), np.concatenate([ends[take], bounds[full + 1]])
                rows, whole = np.concatenate([rows[take], full]), np.arange(len(starts)) >= len(take)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][rows].astype(np.int64)), pa.array(starts - bounds[rows]), pa.array((ends - starts).astype(np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(whole)], ["doc_id", "start", "length", "d0", "d1", "whole"])

    return docs.mapInArrow(cut, "doc_id long, start long, length int, d0 long, d1 long, whole boolean")


def repeated_chunks(docs: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """doc_id, start, length, whole, first_doc: every chunk (or whole text) whose digest an earlier one has (smaller doc_id,
    or earlier in the document), with the document of the earliest. Minima are aggregated before the shuffle, and the join back may be
    split, so that a digest of a third of the rows is no hot group."""
    found = materialize(chunk_table(docs, reach, least))
    first = found.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d0", "d1", "first")
    return found.join(first, ["d0", "d1"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).select("doc_id", "start", "length", "whole", F.col("first.doc_id").alias("first_doc"))


def chunk_report(docs: DataFrame, reach: int = REACH, least: int = LEAST, run: int = RUN) -> DataFrame:
    """For each document that loses chunks: doc_id, n_chunks and n_bytes removed, n_spans, spans (start, end in bytes,
    sorted and apart), first_docs (sorted ids of the documents that keep the bytes). Runs of repeated chunks under `run`
    bytes stay (1 removes them all). Null and empty texts have no chunks; rows of equal doc_id and text are one document;
    rows whose doc_id is null are left out; an empty table gives no rows."""
    docs = documents(docs).where("doc_id IS NOT NULL AND text <> ''")
    gone = repeated_chunks(docs, reach, least).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.struct("start", "length")))).alias("chunks"), F.max(F.when(F.col("whole"), F.col("length").cast("long"))).alias("all"), F.sort_array(F.collect_set("first_doc")).alias("first_docs")
    )
    end = lambda x: (x["start"] + x["length"]).cast("long")
    # Runs are cut where a chunk doesn't begin at the end of the one before; each cut is a chunk's place in the array.
    places = F.filter(F.sequence(F.lit(0), F.size("chunks")), lambda i: (i == 0) | (i == F.size("chunks")) | (end(F.get("chunks", i - 1)) != F.get("chunks", i)["start"]))
    cuts = gone.select("doc_id", "chunks", "first_docs", "all", F.array_distinct(places).alias("cuts"))
    runs = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts")), lambda a, b: F.struct(F.get("chunks", a)["start"].alias("start"), end(F.get("chunks", b - 1)).alias("end"), (b - a).cast("long").alias("n")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("all").alias("end"), F.greatest(F.size("chunks"), F.lit(1)).cast("long").alias("n")))
    kept = cuts.select("doc_id", "first_docs", F.when(F.col("all").isNotNull(), whole).otherwise(F.filter(runs, lambda x: x["end"] - x["start"] >= run)).alias("runs")).where(F.size("runs") > 0)
    total = lambda f: F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + f(x))
    spans = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return kept.select("doc_id", total(lambda x: x["n"]).alias("n_chunks"), total(lambda x: x["end"] - x["start"]).alias("n_bytes"), F.size("runs").cast("long").alias("n_spans"), spans.alias("spans"), "first_docs")


def remove_chunks(docs: DataFrame, reach: int = REACH, least: int = LEAST, run: int = RUN) -> DataFrame:
    """The documents with their own columns, without the bytes of repeated chunks. A null text stays null."""
    report = materialize(chunk_report(docs, reach, least, run).select("doc_id", "spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, rest = text.encode(), 0, []
                for a, b in merge([(x["start"], x["end"]) for x in spans]):
                    rest.append(data[at:a])
                    at = b
                out.append(b"".join([*rest, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out, pa.string())], ["doc_id", "key", "shorter"])

    key = F.xxhash64("text")
    cut = only_ids(documents(docs), report.select("doc_id")).where("text <> ''").join(report, "doc_id").select("doc_id", "text", key.alias("key"), "spans")
    cut = cut.mapInArrow(drop, "doc_id long, key long, shorter string").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "shorter")
    joined = docs.join(cut, (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left")
    return joined.select(*[F.coalesce("shorter", docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
