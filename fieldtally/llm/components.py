"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import materialize

def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Each id's neighbours are linked to the smallest of them and itself: the larger ones (large), or
    the smaller ones and itself. Minima are aggregated before the shuffle, so that an id with many links is no hot group."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that has a link; component is the smallest id that links reach. links: a, b longs.

    Alternates large and small stars until nothing changes; each round is written to the shared folder."""
    now = materialize(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    while True:
        after = materialize(_star(_star(now, True), False))
        # both are sets: of equal size, and nothing in one that the other lacks
        if after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty():
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        now = after
