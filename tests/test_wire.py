"""Strict parsing: what is refused, why, and what is kept."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import scalars
from fieldtally.sinks.http import Http
from fieldtally.sources import wire

UUID = "12345678-1234-1234-1234-123456789abc"
GOOD = {"type": "reading", "buffer_id": UUID, "seq": 1, "device_id": "d", "sensor_id": "s", "value": 1.5, "unit": None, "mono_ns": 1, "wall_ns": 2, "boot_id": "b", "ts_quality": 2, "qc_flag": 2, "qc_tests": ["a"]}
GAP = {"type": "gap", "buffer_id": UUID, "seq": 2, "device_id": "d", "sensor_id": None, "boot_id": "b", "from_mono_ns": 1, "to_mono_ns": 2, "reason": "backpressure", "count": 3}
CASES = [
    (json.dumps(GOOD), None), (json.dumps(GAP), None), (json.dumps(GOOD | {"buffer_id": "{" + UUID.upper() + "}"}), None),
    ("nonsense", "payload is not JSON"), ("[1]", "record is not a JSON object"), ("3", "record is not a JSON object"),
    (json.dumps({k: v for k, v in GOOD.items() if k != "buffer_id"}), "buffer_id must be a UUID"), (json.dumps(GOOD | {"buffer_id": "no"}), "buffer_id must be a UUID"),
    (json.dumps(GOOD | {"seq": -1}), "seq must not be negative"), (json.dumps(GOOD | {"seq": 1 << 63}), "seq must be a 64-bit integer"), (json.dumps(GOOD | {"seq": True}), "seq must be a 64-bit integer"),
    (json.dumps(GOOD | {"sensor_id": "a\0"}), "sensor_id contains a NUL character"), (json.dumps(GOOD | {"sensor_id": 5}), "sensor_id must be a non-empty string"),
    (json.dumps(GOOD | {"ts_quality": 7}), "ts_quality must be 0, 1 or 2"), (json.dumps(GOOD | {"value": "5"}), "value must be a number or null"), (json.dumps(GOOD | {"value": None}), None),
    (json.dumps(GOOD | {"qc_tests": None}), "qc_tests must be a list of strings"), (json.dumps({k: v for k, v in GOOD.items() if k != "qc_tests"}), None), (json.dumps(GOOD | {"qc_tests": []}), None), (json.dumps(GOOD | {"qc_tests": ["a", 1]}), "qc_tests must be a list of strings"),
    (json.dumps(GOOD | {"type": "other"}), "unknown record type"), (json.dumps(GOOD | {"unit": ""}), "unit must be a non-empty string"),
    (json.dumps(GAP | {"count": 0}), "count must be positive"), (json.dumps(GAP | {"count": 1 << 31}), "count is out of range"), (json.dumps(GAP | {"reason": None}), "reason must be a non-empty string"),
    (None, "payload is not JSON"), ("", "payload is not JSON"),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], "i int, payload string")
    got = {r["i"]: r["error"] for r in wire.validate(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES]


def test_round_trip(spark):
    rows = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(GAP),)], "payload string")
    checked = wire.validate(rows)
    readings, gaps = wire.good_readings(checked), wire.good_gaps(checked)
    line = readings.select(wire.to_wire(readings, "reading", "device_id")).first()[0]
    assert json.loads(line) == GOOD
    assert json.loads(gaps.select(wire.to_wire(gaps, "gap", "device_id")).first()[0]) == GAP


def test_lines(spark):
    lines = ['{"sensor_id":"a","value":1}', '{"sensor_id":"a","value":null}', "x", '{"sensor_id":"a","value":1e400}', '{"sensor_id":"","value":1}', '{"sensor_id":"a","value":true}', '{"sensor_id":"a","unit":"C"}']
    got = wire.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).select("line", "bad").collect()
    assert {r["line"]: r["bad"] for r in got} == dict(zip(lines, [False, False, True, True, True, True, False], strict=True))


@pytest.mark.parametrize(
    ("status", "body", "expected"),
    [
        (200, b"", {1: "accepted", 2: "accepted"}),
        (207, b'{"accepted":[1],"rejected":[2]}', {1: "accepted", 2: "rejected"}),
        (422, b'{"rejected":[2,99]}', {2: "rejected"}),
        (400, b"oops", None), (401, b'{"accepted":[1]}', None), (503, b"", None), (302, b"", None),
        (200, b'{"accepted":"all"}', None), (200, b'{"accepted":[1],"rejected":[1]}', None),
    ],
)
def test_http_answers(spark, status, body, expected):
    rows = spark.createDataFrame([(i, UUID, "d", "s") for i in (1, 2)], "seq long, buffer_id string, device_id string, sensor_id string").coalesce(1)
    got = Http("http://x", "d", send_part=lambda *_: (status, body)).send(rows, 0).collect()
    assert {r["seq"]: r["outcome"] for r in got} == (expected or {})


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.finite_or_null(F.lit(float("nan"))).alias("nan"), scalars.finite_or_null(F.lit(float("-inf"))).alias("inf"), scalars.finite_or_null(F.lit(2.0)).alias("two"),
        F.unix_micros(scalars.timestamp_of(F.lit(-1).cast("long"))).alias("t"), scalars.canonical_uuid(F.lit("urn:uuid:" + UUID)).alias("u"), scalars.canonical_uuid(F.lit("x")).alias("no"),
        scalars.corrected_wall(F.lit(0), F.lit((1 << 62) - 1), F.lit(7).cast("long"), F.lit((1 << 63) - 1)).alias("overflow"),
    ).first()
    assert (row["nan"], row["inf"], row["two"], row["t"], row["u"], row["no"], row["overflow"]) == (None, None, 2.0, -1, UUID, None, 7)
