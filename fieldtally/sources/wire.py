"""Records on the wire: strict parsing of what devices send, and the projection back to JSON.

Types are tested on the parsed variant, as casts would let a number pass for a string or true for 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.scalars import canonical_uuid

INT32, INT16 = (1 << 31) - 1, (1 << 15) - 1


def _kind(v: Column, key: str) -> Column:
    """The JSON type of a field: VOID for null, null where the field is missing."""
    return F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant"))


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _bad_text(v: Column, key: str, nullable: bool = False) -> Column:
    kind, text = F.coalesce(_kind(v, key), F.lit("VOID")), _get(v, key, "string")
    absent = kind == "VOID"
    wrong = (~absent & ((kind != "STRING") | (text == ""))) | (F.lit(False) if nullable else absent)
    return F.when(wrong, f"{key} must be a non-empty string").when((kind == "STRING") & F.contains(text, F.lit("\0")), f"{key} contains a NUL character")


def _bad_int(v: Column, key: str, most: int | None = None) -> Column:
    bad = F.coalesce(_kind(v, key), F.lit("VOID")) != "BIGINT"
    out = F.when(bad, f"{key} must be a 64-bit integer")
    return out if most is None else out.when(~_get(v, key, "long").between(-most - 1, most), f"{key} is out of range")


def _bad(condition: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)), message)


# The texts of errors, and the order in which the rules are tried.
def error_of(v: Column) -> Column:
    """The first rule that a parsed record breaks; null for a good one."""
    is_object = F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")
    kind = F.coalesce(F.when(F.coalesce(_kind(v, "type"), F.lit("")) == "STRING", _get(v, "type", "string")), F.lit("?"))
    number = F.coalesce(_kind(v, "value"), F.lit("VOID")).rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    value = _get(v, "value", "double")
    value_ok = number & F.coalesce((_kind(v, "value") == "VOID") | (F.abs(value) < float("inf")), _kind(v, "value").isNull())
    tests = _kind(v, "qc_tests")
    tests_ok = tests.isNull() | tests.isin("ARRAY<STRING>", "ARRAY<VOID>")
    tests_ok = tests_ok & ~F.coalesce(F.exists(_get(v, "qc_tests", "array<string>"), lambda t: t.isNull() | F.contains(t, F.lit("\0"))), F.lit(False))
    head = [
        _bad(~is_object, "record is not a JSON object"),
        _bad((_kind(v, "buffer_id") != "STRING") | canonical_uuid(_get(v, "buffer_id", "string")).isNull(), "buffer_id must be a UUID"),
        _bad_int(v, "seq"),
        _bad(_get(v, "seq", "long") < 0, "seq must not be negative"),
        _bad_text(v, "device_id"),
    ]
    reading = [
        _bad(~value_ok, "value must be a number or null"),
        _bad(~tests_ok, "qc_tests must be a list of strings"),
        _bad_int(v, "ts_quality"),
        _bad(~_get(v, "ts_quality", "long").isin(0, 1, 2), "ts_quality must be 0, 1 or 2"),
        _bad_text(v, "sensor_id"), _bad_text(v, "unit", True), _bad_int(v, "mono_ns"), _bad_int(v, "wall_ns"), _bad_text(v, "boot_id"), _bad_int(v, "qc_flag", INT16),
    ]
    gap = [
        _bad_int(v, "count", INT32), _bad(_get(v, "count", "long") <= 0, "count must be positive"),
        _bad_text(v, "sensor_id", True), _bad_text(v, "boot_id"), _bad_int(v, "from_mono_ns"), _bad_int(v, "to_mono_ns"), _bad_text(v, "reason"),
    ]
    rest = F.when(kind == "reading", F.coalesce(*reading)).when(kind == "gap", F.coalesce(*gap)).otherwise("unknown record type")
    return F.coalesce(*head, rest)


def validate(bronze: DataFrame) -> DataFrame:
    """Adds `record` (variant) and `error` to payloads. Every row stays: those with an error are dead letters."""
    parsed = bronze.withColumn("record", F.try_parse_json("payload"))
    return parsed.withColumn("error", F.when(F.col("record").isNull(), "payload is not JSON").otherwise(error_of(F.col("record"))))


def dead_letters(validated: DataFrame) -> DataFrame:
    return validated.where("error IS NOT NULL").drop("record")


def good_readings(validated: DataFrame) -> DataFrame:
    v, rest = F.col("record"), [c for c in validated.columns if c not in ("record", "error", "payload")]
    got = validated.where("error IS NULL").where(_get(v, "type", "string") == "reading")
    fields = [("device_id", "string"), ("sensor_id", "string"), ("value", "double"), ("unit", "string"), ("mono_ns", "long"), ("wall_ns", "long"), ("boot_id", "string"), ("ts_quality", "short"), ("qc_flag", "short")]
    return got.select(canonical_uuid(_get(v, "buffer_id", "string")).alias("buffer_id"), _get(v, "seq", "long").alias("seq"), *[_get(v, n, k).alias(n) for n, k in fields], F.coalesce(_get(v, "qc_tests", "array<string>"), F.array().cast("array<string>")).alias("qc_tests"), *rest)


def good_gaps(validated: DataFrame) -> DataFrame:
    v, rest = F.col("record"), [c for c in validated.columns if c not in ("record", "error", "payload")]
    got = validated.where("error IS NULL").where(_get(v, "type", "string") == "gap")
    fields = [("device_id", "string"), ("sensor_id", "string"), ("boot_id", "string"), ("from_mono_ns", "long"), ("to_mono_ns", "long"), ("reason", "string"), ("count", "int")]
    return got.select(canonical_uuid(_get(v, "buffer_id", "string")).alias("buffer_id"), _get(v, "seq", "long").alias("seq"), *[_get(v, n, k).alias(n) for n, k in fields], *rest)


READING_KEYS = ("buffer_id", "seq", "type", "sensor_id", "value", "unit", "mono_ns", "wall_ns", "boot_id", "ts_quality", "qc_flag", "qc_tests")
GAP_KEYS = ("buffer_id", "seq", "type", "sensor_id", "boot_id", "from_mono_ns", "to_mono_ns", "reason", "count")


def to_wire(records: DataFrame, kind: str, *ahead: str) -> Column:
    """JSON of a reading or gap, nulls kept; `ahead` names columns that come before the record's own keys."""
    keys = READING_KEYS if kind == "reading" else GAP_KEYS
    column = lambda k: F.lit(kind).alias(k) if k == "type" else records[k] if k in records.columns else F.lit(None).cast("string").alias(k)
    return F.to_json(F.struct(*[column(k) for k in (*ahead, *keys)]), {"ignoreNullFields": "false"})


def parse_lines(lines: DataFrame) -> DataFrame:
    """Readings from JSON lines (column value): sensor_id, value, unit, and whether the line is bad."""
    v = F.try_parse_json("value")
    number = F.coalesce(_kind(v, "value"), F.lit("VOID")).rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & F.coalesce(F.abs(_get(v, "value", "double")) < float("inf"), F.lit(True))
    unit = F.coalesce(_kind(v, "unit"), F.lit("VOID")).isin("VOID", "STRING")
    sensor = (F.coalesce(_kind(v, "sensor_id"), F.lit("")) == "STRING") & (_get(v, "sensor_id", "string") != "")
    ok = F.coalesce(reduce(Column.__and__, [F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), sensor, number, unit, F.is_valid_utf8("value")]), F.lit(False))
    return lines.select("value", ok.alias("good"), v.alias("v")).select(F.when(F.col("good"), _get(F.col("v"), "sensor_id", "string")).alias("sensor_id"), F.when(F.col("good"), _get(F.col("v"), "value", "double")).alias("reading"), F.when(F.col("good"), _get(F.col("v"), "unit", "string")).alias("unit"), (~F.col("good")).alias("bad"), F.col("value").alias("line"))
