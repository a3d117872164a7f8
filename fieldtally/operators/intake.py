"""What a spool takes of a stream's batches that may come again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def taken(attempts: DataFrame) -> DataFrame:
    """attempts (source, batch, pos, n: in the order of pos, a batch of n readings) with `taken` and `next_seq`, the number
    that the source's next reading gets. A batch is taken if its number is above those of all that came before from its
    source: a stream's batches are numbered upwards, so any other has been taken. One row for each batch is windowed."""
    at = Window.partitionBy("source").orderBy("pos")
    before = F.max("batch").over(at.rowsBetween(Window.unboundedPreceding, -1))
    told = attempts.withColumn("taken", F.coalesce(F.col("batch") > before, F.lit(True)))
    return told.withColumn("next_seq", F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
