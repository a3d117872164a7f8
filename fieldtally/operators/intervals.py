"""Sets of sequence numbers as intervals: what a receiver has stored of each buffer, in as many rows as there are holes.

A set is a table (buffer_id, part, low, high), intervals both ends included, apart and not adjoining within a part; part is
floor(low / PART), and no interval crosses its part. Union is associative and has the empty table for its unit, so sets of
batches are folded in any order. One buffer's numbers are dealt out by part, so none is a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = "buffer_id string, part long, low long, high long"
#: Numbers of a part.
PART = 1 << 20
#: Intervals up to which a set is broadcast: about 60 bytes each.
FEW = 200_000


def interval_set(keys: DataFrame, part: int = PART) -> DataFrame:
    """The set of the (buffer_id, seq) of a table; repeated ones are one."""
    points = keys.select("buffer_id", F.floor(F.col("seq") / part).alias("part"), "seq").distinct()
    run = F.col("seq") - F.row_number().over(Window.partitionBy("buffer_id", "part").orderBy("seq"))
    return points.withColumn("_run", run).groupBy("buffer_id", "part", "_run").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).drop("_run")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The numbers that one of two sets holds: intervals that overlap or adjoin become one."""
    at = Window.partitionBy("buffer_id", "part").orderBy("low", "high")
    both = a.unionByName(b).withColumn("_reach", F.max("high").over(at.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(F.col("_reach").isNull() | (F.col("low") > F.col("_reach") + 1), 1).otherwise(0)
    islands = both.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("buffer_id", "part", "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def outside(rows: DataFrame, held: DataFrame, part: int = PART, few: int = FEW) -> DataFrame:
    """The rows whose (buffer_id, seq) the set doesn't hold. The set is broadcast while it is small, else both are dealt out
    by buffer and part."""
    small = held.limit(few + 1).count() <= few
    sets = held.select(F.col("buffer_id").alias("_buffer"), F.col("part").alias("_part"), "low", "high")
    inside = (F.col("buffer_id") == F.col("_buffer")) & (F.floor(F.col("seq") / part) == F.col("_part")) & F.col("seq").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(sets) if small else sets, inside, "left_anti")


def size(held: DataFrame) -> DataFrame:
    """By buffer: how many numbers a set holds, in how many whole intervals (those of neighbouring parts that adjoin are
    one), the lowest and the highest number, and how many are missing between."""
    at = Window.partitionBy("buffer_id").orderBy("low")
    joined = held.withColumn("_adjoins", F.when(F.col("low") == F.lag("high").over(at) + 1, 1).otherwise(0))
    out = joined.groupBy("buffer_id").agg(F.sum(F.col("high") - F.col("low") + 1).alias("n"), F.sum(1 - F.col("_adjoins")).alias("intervals"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.withColumn("missing", F.col("high") - F.col("low") + 1 - F.col("n"))
