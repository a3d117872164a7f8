"""Schemas of the tables. They are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


def _of(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


S, L, D, I, H = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.ShortType()  # noqa: E741

READING = _of(("buffer_id", S, False), ("seq", L, False), ("device_id", S, False), ("sensor_id", S, False), ("value", D, True), ("unit", S, True), ("mono_ns", L, False), ("wall_ns", L, False), ("boot_id", S, False), ("ts_quality", H, False), ("qc_flag", H, False), ("qc_tests", T.ArrayType(S, False), False))
GAP = _of(("buffer_id", S, False), ("seq", L, False), ("device_id", S, False), ("sensor_id", S, True), ("boot_id", S, False), ("from_mono_ns", L, False), ("to_mono_ns", L, False), ("reason", S, False), ("count", I, False))
BOOT_CLOCK = _of(("boot_id", S, False), ("offset_ns", L, False), ("mono_ns", L, False))
DEAD_LETTER = _of(("source", S, True), ("payload", S, True), ("error", S, False))
BRONZE = _of(("source", S, True), ("payload", S, True), ("arrival_batch", L, False), ("arrival_pos", L, False))
TRANSITION = _of(("buffer_id", S, False), ("id", L, False), ("pos", L, False), ("to_state", I, False))

#: Fixed values of the data model.
PENDING, INFLIGHT, ACKED, REJECTED = range(4)
UNSYNCED, CORRECTED, SYNCED = range(3)
DROP_OLDEST, BACKPRESSURE, REJECTED_BY_SINK = "retention:drop_oldest", "backpressure", "rejected:sink"
