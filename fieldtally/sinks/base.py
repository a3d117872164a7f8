"""What a sink is, and the loop that ships batches to it.

A sink takes the records of one batch and answers which were accepted and which rejected for good; records it doesn't
name are sent again, and an exception fails the batch. Keys make redelivery harmless, so at-least-once is enough.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from fieldtally.operators.delivery import outcomes, progress


class Sink(Protocol):
    def send(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows (buffer_id, seq, outcome) for the records of the batch; outcome is accepted or rejected."""


class SendFailed(Exception):
    pass


def delay_after(failures: int, initial_s: float = 0.5, max_s: float = 60.0, multiplier: float = 2.0, immediate: int = 2) -> float:
    return 0.0 if failures <= immediate else min(max_s, initial_s * multiplier ** min(failures - immediate - 1, 64))


def shipping(sink: Sink, record: Callable[[DataFrame, int], None], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: sends, resolves the answers, sends what was released again, and records the outcomes.
    After so many failures the batch fails, and the stream's checkpoint repeats it."""

    def ship(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        left, failures, attempt = batch, 0, 0
        while not left.isEmpty():
            try:
                answers = sink.send(left, batch_id).withColumnRenamed("buffer_id", "batch")
                resolved = outcomes(left.withColumn("batch", F.col("buffer_id")), answers).checkpoint()
                moved = not progress(resolved).where("result = 'progress'").isEmpty()
                record(resolved.where("outcome <> 'released'").withColumn("attempt", F.lit(attempt)), batch_id)
                left = resolved.where("outcome = 'released'").select(batch.columns)
            except SendFailed:
                moved = False
            failures = 0 if moved else failures + 1
            attempt += 1
            if failures > attempts:
                raise SendFailed(f"batch {batch_id}: no progress in {failures} attempts")
            if failures:
                sleep(delay_after(failures))

    return ship
