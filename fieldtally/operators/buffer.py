"""A device's buffer as tables: appending under a cap, the moves of claimed rows, quarantine and purging.

rows: buffer_id, seq, state, sensor_id, boot_id, mono_ns and whatever else; gaps: buffer_id, gap_id, seq (null until the
gap is sealed), state, sensor_id, boot_id, from_mono_ns, to_mono_ns, reason, count. Each function gives new tables; both
results of one are written together by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.retention import gap_summary, top
from fieldtally.operators.small import beside
from fieldtally.schemas import ACKED, BACKPRESSURE, DROP_OLDEST, INFLIGHT, PENDING, REJECTED, REJECTED_BY_SINK

KEYS = ("buffer_id", "seq")


def overflow(held: DataFrame, incoming: DataFrame, cap: int) -> DataFrame:
    """By buffer with incoming rows: pending ones, and how many rows are too many (`over`), of the unacknowledged and the
    incoming ones together."""
    here = held.groupBy("buffer_id").agg(F.count_if(F.col("state") == PENDING).alias("pending"), F.count_if(F.col("state").isin(PENDING, INFLIGHT)).alias("unacked"))
    coming = incoming.groupBy("buffer_id").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    return coming.join(here, "buffer_id", "left").select("buffer_id", F.coalesce("pending", zero).alias("pending"), F.greatest(F.coalesce("unacked", zero) + F.col("n") - cap, zero).alias("over"))


def append(held: DataFrame, incoming: DataFrame, cap: int, policy: str = "drop_oldest") -> tuple[DataFrame, DataFrame]:
    """The rows of all buffers after each took a batch, and the gaps for what that cost.

    drop_oldest evicts the oldest pending rows, never those in flight, and if they don't suffice the oldest of the batch.
    halt_and_alarm refuses a batch whole that doesn't fit. incoming: rows without a state; they come in as pending."""
    over = beside(overflow(held, incoming, cap))
    added = incoming.withColumn("state", F.lit(PENDING)).select(held.columns)
    if policy == "halt_and_alarm":
        full = over.where("over > 0").select("buffer_id")
        gaps = gap_summary(added.join(full, "buffer_id", "left_semi"), BACKPRESSURE, "buffer_id")
        return held.unionByName(added.join(full, "buffer_id", "left_anti")), gaps
    short = over.withColumn("over", F.col("over") - F.least("over", "pending"))
    pending = held.where(F.col("state") == PENDING)
    old = marked(held, cutoff(pending, over), F.col("state") == PENDING)
    both = old.unionByName(marked(added, cutoff(added, short), F.lit(True)))
    return both.where("NOT _hit").drop("_hit"), gap_summary(both.where("_hit"), DROP_OLDEST, "buffer_id")


def cutoff(rows: DataFrame, k: int | DataFrame, descending: bool = False) -> DataFrame:
    """Of each buffer the number (`_cut`) of the k-th of these rows, the last if there are fewer: one row for each buffer,
    so that what is on one side of it is told without ranking all."""
    last = F.min("seq") if descending else F.max("seq")
    return top(rows, k, descending=descending).groupBy("buffer_id").agg(last.alias("_cut"))


def marked(rows: DataFrame, cuts: DataFrame, which: Column, descending: bool = False) -> DataFrame:
    """rows with `_hit`: those of `which` up to the cut of their buffer. Cuts are a row for each buffer."""
    near = F.col("seq") >= F.col("_cut") if descending else F.col("seq") <= F.col("_cut")
    return rows.join(beside(cuts), "buffer_id", "left").withColumn("_hit", F.coalesce(which & near, F.lit(False))).select(*rows.columns, "_hit")


def claim(rows: DataFrame, n: int) -> DataFrame:
    """All rows, the oldest n pending ones of each buffer in flight. A released row has its old seq, so it comes first again."""
    is_pending = F.col("state") == PENDING
    taken = marked(rows, cutoff(rows.where(is_pending), n), is_pending)
    return taken.withColumn("state", F.when(F.col("_hit"), INFLIGHT).otherwise(F.col("state"))).drop("_hit")


def moved(rows: DataFrame, ids: DataFrame, to_state: int) -> DataFrame:
    """All rows; those in flight that ids (buffer_id, seq) name are in to_state. Other rows that they name stay as they are."""
    named = ids.select(*KEYS).distinct().withColumn("_named", F.lit(True))
    return rows.join(named, [*KEYS], "left").withColumn("state", F.when(F.col("_named") & (F.col("state") == INFLIGHT), to_state).otherwise(F.col("state"))).select(rows.columns)


def ack(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return moved(rows, ids, ACKED)


def release(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return moved(rows, ids, PENDING)


def reject(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with those in flight that ids name in quarantine, and the gaps that count exactly these."""
    refused = rows.where(F.col("state") == INFLIGHT).join(ids.select(*KEYS).distinct(), [*KEYS], "left_semi")
    return moved(rows, ids, REJECTED), gap_summary(refused, REJECTED_BY_SINK, "buffer_id")


def reject_gaps(gaps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gaps with those in flight that ids name in quarantine, and by buffer what the sink's accounting is short by
    now: there is no gap of a gap, so someone must be told."""
    refused = gaps.where(F.col("state") == INFLIGHT).join(ids.select(*KEYS).distinct(), [*KEYS], "left_semi")
    return moved(gaps, ids, REJECTED), refused.groupBy("buffer_id").agg(F.count(F.lit(1)).alias("gaps"), F.sum("count").alias("unaccounted"))


def recover(rows: DataFrame) -> DataFrame:
    """After a crash: what was in flight is pending again. For readings and gaps."""
    return rows.withColumn("state", F.when(F.col("state") == INFLIGHT, PENDING).otherwise(F.col("state")))


def sendable_gaps(gaps: DataFrame, n: int) -> DataFrame:
    """The oldest n pending sealed gaps of each buffer."""
    return top(gaps.where((F.col("state") == PENDING) & F.col("seq").isNotNull()), n).drop("nth")


def purge(rows: DataFrame, gaps: DataFrame, limit: int | None = 10_000, keep: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Readings and gaps without the oldest `limit` acknowledged readings of each buffer (None: all), all acknowledged
    gaps, and all but the newest `keep` of each in quarantine."""
    is_acked, is_rejected = F.col("state") == ACKED, F.col("state") == REJECTED

    def trimmed(table: DataFrame) -> DataFrame:
        newest = marked(table, cutoff(table.where(is_rejected), keep, descending=True), is_rejected, descending=True)
        return newest.where(~is_rejected | F.col("_hit")).drop("_hit")

    left = rows.where(~is_acked) if limit is None else marked(rows, cutoff(rows.where(is_acked), limit), is_acked).where("NOT _hit").drop("_hit")
    return trimmed(left), trimmed(gaps.where(~is_acked))


def status(rows: DataFrame, gaps: DataFrame, cap: int, policy: str, file_bytes: int = 0) -> DataFrame:
    """A row for each buffer: rows by state, the cap and policy they stand under, gaps not yet shipped, readings counted in
    gaps, and the bytes on disk of all buffers."""
    of = lambda *states: F.count_if(F.col("state").isin(*states))
    counts = rows.groupBy("buffer_id").agg(of(PENDING).alias("pending"), of(INFLIGHT).alias("inflight"), of(ACKED).alias("acked_not_purged"), of(REJECTED).alias("quarantined"), of(PENDING, INFLIGHT).alias("unacked"))
    in_gaps = gaps.groupBy("buffer_id").agg(of(PENDING, INFLIGHT).alias("unshipped_gaps"), F.sum("count").alias("discarded_in_buffered_gaps"))
    both = counts.join(in_gaps, "buffer_id", "full_outer").na.fill(0)
    return both.withColumns({"exists": F.lit(True), "cap": F.lit(cap).cast("long"), "policy": F.lit(policy), "file_bytes": F.lit(file_bytes).cast("long")})
