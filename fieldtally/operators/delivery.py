"""Delivery: the states of buffered rows, and what a sink's answers make of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.retention import beyond, top
from fieldtally.schemas import ACKED, INFLIGHT, PENDING, REJECTED

def states(transitions: DataFrame, part_moves: int = 100_000) -> DataFrame:
    """(buffer_id, id, state) after all transitions in order of pos (then of to_state); those that their state doesn't allow
    are no-ops: a pending row can be claimed, a claimed one released, acknowledged or rejected, and the last two are final.

    So a row is claimed where the last claim or release before is a claim, and its first answer while it is claimed is
    final. An id's history is looked through within ranges of pos, by many tasks; what each leaves is put in order."""
    by, moves = ["buffer_id", "id"], transitions.withColumn("_part", F.floor(F.col("pos") / part_moves))
    move = F.struct("pos", "to_state")
    toggles, answers = F.col("to_state").isin(PENDING, INFLIGHT), F.col("to_state").isin(ACKED, REJECTED)
    earlier = Window.partitionBy(*by, "_part").orderBy("pos", "to_state").rowsBetween(Window.unboundedPreceding, -1)
    told = moves.withColumn("_at", F.last(F.when(toggles, F.col("to_state")), ignorenulls=True).over(earlier))
    parts = told.groupBy(*by, "_part").agg(
        F.max(F.when(toggles, move))["to_state"].alias("last"),
        F.min(F.when(answers & (F.col("_at") == INFLIGHT), move)).alias("answer"),
        F.min(F.when(answers & F.col("_at").isNull(), move)).alias("early"),
    )
    before = Window.partitionBy(*by).orderBy("_part")
    came = F.last("last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("answer", F.least("answer", F.when(came == INFLIGHT, F.col("early"))))
    ends = parts.groupBy(*by).agg(F.min(F.when(F.col("answer").isNotNull(), F.struct("_part", "answer")))["answer"]["to_state"].alias("final"), F.max(F.when(F.col("last").isNotNull(), F.struct("_part", "last")))["last"].alias("last"))
    return ends.select(*by, F.coalesce("final", "last", F.lit(PENDING)).cast("int").alias("state"))


def state_histogram(rows: DataFrame) -> DataFrame:
    """(state, n) of all four states, those without rows as 0."""
    every = rows.sparkSession.range(4).select(F.col("id").cast("int").alias("state"))
    return every.join(rows.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def claim_oldest(pending: DataFrame, n: int) -> DataFrame:
    """The oldest n rows of each buffer."""
    return top(pending, n)


def kth_oldest(pending: DataFrame, k: int) -> DataFrame:
    return top(pending, k).where(F.col("nth") == k)


def keep_newest(rows: DataFrame, k: int) -> DataFrame:
    """Quarantine keeps the newest k rows of each buffer."""
    return top(rows, k, descending=True).drop("nth")


def purge_oldest(acked: DataFrame, n: int) -> DataFrame:
    """What a purge of the oldest n acknowledged rows of each buffer leaves."""
    return beyond(acked, n)


def outcomes(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """The outcome of each sent row: accepted, rejected, or released to be sent again. Answers for rows that were not sent
    count nothing. A batch of several rows that are all rejected is a fault of the sink: it is released whole.
    sent: batch, seq; answers: batch, seq, outcome."""
    answered = sent.join(answers.select("batch", "seq", "outcome"), ["batch", "seq"], "left")
    totals = answered.groupBy("batch").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("outcome") == "rejected").alias("_rejected"))
    fault = (F.col("_n") > 1) & (F.col("_rejected") == F.col("_n"))
    return answered.join(totals, "batch").withColumn("outcome", F.when(fault, "released").otherwise(F.coalesce(F.when(F.col("outcome").isin("accepted", "rejected"), F.col("outcome")), F.lit("released")))).drop("_n", "_rejected")


def progress(resolved: DataFrame) -> DataFrame:
    """By batch: counts by outcome, and whether anything moved on."""
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return resolved.groupBy("batch").agg(count("accepted"), count("rejected"), count("released")).withColumn("result", F.when(F.col("accepted") + F.col("rejected") > 0, "progress").otherwise("failed"))
