"""Small sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side with a row for each buffer or boot is worked out first and broadcast: some 100 bytes each.
FEW = 50_000


def beside(df: DataFrame, few: int = FEW) -> DataFrame:
    """df, worked out and broadcast if it has few rows, so that the other side of a join isn't dealt out by a key that one
    buffer or boot may fill; else df as it is. For tables of short columns; a stream is left alone."""
    if df.isStreaming:
        return df
    rows = df.limit(few + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= few else df
