"""Scalar functions on telemetry columns; all are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.schemas import CORRECTED, UNSYNCED

#: Clock values from here on are taken for garbage: sums of two below it can't overflow.
SANE_BELOW = 1 << 62


def sane(ns: Column) -> Column:
    return ns.between(0, SANE_BELOW - 1)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def trusted(ts_quality: Column, mono_ns: Column, wall_ns: Column) -> Column:
    """Whether a reading may define its boot's clock."""
    return (ts_quality != UNSYNCED) & sane(mono_ns) & sane(wall_ns)


def corrected_wall(ts_quality: Column, mono_ns: Column, wall_ns: Column, offset_ns: Column) -> Column:
    """Wall time by the boot's offset, for unsynced readings that have one; else as it is."""
    return F.coalesce(F.when((ts_quality == UNSYNCED) & sane(mono_ns), F.try_add(mono_ns, offset_ns)), wall_ns)


def corrected_quality(ts_quality: Column, mono_ns: Column, offset_ns: Column) -> Column:
    done = (ts_quality == UNSYNCED) & sane(mono_ns) & F.try_add(mono_ns, offset_ns).isNotNull()
    return F.when(F.coalesce(done, F.lit(False)), F.lit(CORRECTED)).otherwise(ts_quality)


def backoff_base(failures: Column, initial_s: float = 0.5, max_s: float = 60.0, multiplier: float = 2.0, immediate: int = 2) -> Column:
    """Delay after so many failures in a row, before jitter: none for the first ones, then doubling up to the most."""
    k = F.least(failures - immediate - 1, F.lit(64))
    return F.when(failures <= immediate, 0.0).otherwise(F.least(F.lit(max_s), F.lit(initial_s) * F.pow(F.lit(multiplier), k)))


def backoff_delay(failures: Column, seed: int = 0, **settings) -> Column:
    """backoff_base, spread at random over its upper half."""
    base = backoff_base(failures, **settings)
    return base / 2 + F.rand(seed) * base / 2


def canonical_uuid(text: Column) -> Column:
    """Lower-case UUID with hyphens, from the spellings that Python's uuid module takes (prefixes in lower case, braces
    around the digits, hyphens anywhere); null where the text is none."""
    bare = F.lower(F.replace(F.btrim(F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), F.lit("{}")), F.lit("-"), F.lit("")))
    parts = F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), parts)


def topic_part(text: Column) -> Column:
    """Escapes what has a meaning in topics; the percent sign first."""
    for char, code in (("%", "%25"), ("/", "%2F"), ("+", "%2B"), ("#", "%23"), ("\0", "%00")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def topic(device_id: Column, buffer_id: Column, kind: Column, sensor_id: Column) -> Column:
    """device/buffer/kind/sensor; a record of all sensors has `_all`."""
    return F.concat_ws("/", topic_part(device_id), topic_part(buffer_id), kind, F.coalesce(topic_part(sensor_id), F.lit("_all")))


def puback_class(code: Column) -> Column:
    """accepted, rejected for good, or retry, by the broker's reason code; a missing code is a retry."""
    return F.when(code < 0x80, "accepted").when(code.isin(0x87, 0x90, 0x99), "rejected").otherwise("retry")


def http_class(status: Column, accepted: Column, rejected: Column, seq: Column) -> Column:
    """Outcome of one sent record by the response: lists name records (2xx, 400, 422), a 2xx without lists accepts all,
    anything else fails the batch."""
    lists = accepted.isNotNull() | rejected.isNotNull()
    per_record = F.when(F.coalesce(F.array_contains(rejected, seq), F.lit(False)), "rejected").when(F.coalesce(F.array_contains(accepted, seq), F.lit(False)), "accepted").otherwise("retry")
    success = status.between(200, 299)
    return F.when(lists & (success | status.isin(400, 422)), per_record).when(success, "accepted").otherwise("retry")


def timestamp_of(ns: Column) -> Column:
    """Exact to the microsecond, rounded down."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))
