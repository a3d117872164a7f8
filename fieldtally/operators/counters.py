"""Counters of buffers that are kept, not counted anew: signed changes of each move, folded into what was counted before.

counts: buffer_id, kind (`reading` or `gap`), state, n (rows in that state) and discarded (readings that those gaps count; 0
for readings). A move's change is worked out from the rows that moved, so folding it costs what the move costs and one row
for each buffer, kind and state; the whole table is never read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.schemas import ACKED, INFLIGHT, PENDING, REJECTED

COUNTS = "buffer_id string, kind string, state int, n long, discarded long"
KEYS = ("buffer_id", "kind", "state")


def recount(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """The counters of tables, from their rows. For a spool that has none yet, and to hold kept ones against."""
    of = lambda table, kind, discarded: table.groupBy("buffer_id", F.col("state").cast("int").alias("state")).agg(F.count(F.lit(1)).alias("n"), discarded.cast("long").alias("discarded")).withColumn("kind", F.lit(kind))
    return of(rows, "reading", F.max(F.lit(0))).unionByName(of(gaps, "gap", F.coalesce(F.sum("count"), F.lit(0)))).select(*[x.split()[0] for x in COUNTS.split(", ")])


def change(moved: DataFrame, kind: str, state: int | Column, sign: int = 1) -> DataFrame:
    """The change that rows make which come into a state (sign 1) or leave it (-1); for gaps moved has their count."""
    discarded = F.sum("count") if kind == "gap" else F.max(F.lit(0))
    state = state if isinstance(state, Column) else F.lit(state)
    of_state = moved.groupBy("buffer_id", state.cast("int").alias("state")).agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.coalesce(discarded, F.lit(0))).cast("long").alias("discarded"))
    return of_state.select("buffer_id", F.lit(kind).alias("kind"), "state", "n", "discarded")


def moves(moved: DataFrame, kind: str, before: int, after: int) -> list[DataFrame]:
    """The changes of rows that go from one state to another."""
    return [change(moved, kind, before, -1), change(moved, kind, after)]


def fold(counts: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """The counters after changes, those at zero left out."""
    every = reduce(DataFrame.unionByName, changes, counts)
    total = every.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("discarded").alias("discarded"))
    return total.where("n <> 0 OR discarded <> 0").select(counts.columns)


def status(counts: DataFrame, cap: int, policy: str, file_bytes: int = 0) -> DataFrame:
    """What operators.buffer.status gives, from the counters alone: a row for each buffer."""
    of = lambda name, kind, column, *states: F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("state").isin(*states), F.col(column))), F.lit(0)).cast("long").alias(name)
    every = (PENDING, INFLIGHT, ACKED, REJECTED)
    out = counts.groupBy("buffer_id").agg(
        of("pending", "reading", "n", PENDING), of("inflight", "reading", "n", INFLIGHT), of("acked_not_purged", "reading", "n", ACKED), of("quarantined", "reading", "n", REJECTED),
        of("unacked", "reading", "n", PENDING, INFLIGHT), of("unshipped_gaps", "gap", "n", PENDING, INFLIGHT), of("discarded_in_buffered_gaps", "gap", "discarded", *every),
    )
    return out.withColumns({"exists": F.lit(True), "cap": F.lit(cap).cast("long"), "policy": F.lit(policy), "file_bytes": F.lit(file_bytes).cast("long")})
