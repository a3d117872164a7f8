"""Send timeouts, abandoned sends and late answers."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import answers
from fieldtally.plans import catalogue
from fieldtally.sinks.base import SendFailed
from fieldtally.sinks.memory import Hang, Scripted
from fieldtally.streaming.shipper import Shipper, Spool
from test_spool import contents, readings

START = datetime(2026, 1, 1)
SENDS = "buffer_id string, seq long, attempt int, sent_at timestamp"
ANSWERS = "buffer_id string, seq long, attempt int, answered_at timestamp, outcome string"


def seconds(x):
    return START + timedelta(seconds=x)


def test_a_hung_send_is_released_and_its_late_success_is_a_duplicate(spark, tmp_path):
    spool = Spool(spark, f"{tmp_path}/spool")
    spool.append(readings(spark, 0, 6))
    sink = Scripted([Hang(6.0, late_accept=True)])
    shipper = Shipper(spool, sink, Scripted([]), send_timeout_s=3.0)
    assert shipper.once() == "failed" and shipper.stats["timeouts"] == 1 and len(shipper.hung) == 1
    assert {r["state"] for r in spool.table("rows").collect()} == {0}
    shipper.send_timeout_s = 120.0
    assert shipper.once() == "progress" and spool.status().first()["acked_not_purged"] == 6
    deadline = time.monotonic() + 90
    while len(sink.delivered) < 12 and time.monotonic() < deadline:
        time.sleep(0.2)
    assert sorted(sink.delivered) == sorted(2 * [("buf", i) for i in range(6)])  # the same keys, twice
    assert contents(spool)[1] == [("buf", 6)] and spool.status().first()["acked_not_purged"] == 6


def test_no_more_is_sent_while_too_many_hang(spark, tmp_path):
    spool = Spool(spark, f"{tmp_path}/spool")
    spool.append(readings(spark, 0, 2))
    shipper = Shipper(spool, Scripted([Hang(8.0)] * 2), Scripted([]), send_timeout_s=0.5, most_hung=2)
    assert [shipper.once() for _ in range(3)] == ["failed"] * 3
    assert shipper.stats == {"sends": 2, "timeouts": 2, "failed_sends": 3}
    with pytest.raises(SendFailed):
        shipper.run(0, sleep=lambda s: None)


def made(rng, n):
    sends, said = [], []
    for i in range(n):
        for attempt in range(rng.randint(1, 3)):
            at = 5 * i + 40 * attempt
            sends.append(("b" + str(i % 3), i, attempt, seconds(at)))
            if rng.random() < 0.8:
                said += [(*sends[-1][:3], seconds(at + rng.choice([0, 1, 29, 30, 31, 45, 59, 61])), rng.choice(["accepted", "rejected"])) for _ in range(rng.randint(1, 2))]
    return sends, said


def plain(sends, said, timeout, known):
    first = {}
    for b, s, a, at, outcome in said:
        first[b, s, a] = min(first.get((b, s, a), (at, outcome)), (at, outcome))
    resolved, late = {}, {}
    for b, s, a, at in sends:
        got = first.get((b, s, a))
        wait = (got[0] - at).total_seconds() if got else None
        resolved[b, s, a] = got[1] if got and wait <= timeout else "timed_out"
        if got and timeout < wait <= known:
            late[b, s, a] = got[1]
    return resolved, late


def test_outcomes_equal_a_plain_version(spark):
    sends, said = made(random.Random(2), 40)
    s, a = spark.createDataFrame(sends, SENDS), answers.first_answers(spark.createDataFrame(said, ANSWERS))
    resolved, late = plain(sends, said, 30, 60)
    assert {(r["buffer_id"], r["seq"], r["attempt"]): r["outcome"] for r in answers.resolve(s, a, 30).collect()} == resolved
    assert {(r["buffer_id"], r["seq"], r["attempt"]): r["outcome"] for r in answers.late_answers(s, a, 30, 60).collect()} == late
    for r in answers.deliveries(answers.resolve(s, a, 30), answers.late_answers(s, a, 30, 60)).collect():
        mine = sorted((k[2], o) for k, o in resolved.items() if k[:2] == (r["buffer_id"], r["seq"]))
        took = [o for k, o in [*resolved.items(), *late.items()] if k[:2] == (r["buffer_id"], r["seq"]) and o == "accepted"]
        assert (r["attempts"], r["outcome"], r["copies"]) == (len(mine), mine[-1][1].replace("timed_out", "released"), len(took))


def test_one_pass_equals_outcomes_and_late_answers_by_joins(spark):
    """Also with answers for attempts that were not made, without an outcome, or without a time."""
    sends, said = made(random.Random(4), 60)
    said += [("b0", 0, 7, seconds(1), "accepted"), ("b9", 1, 0, seconds(1), "accepted"), ("b0", 3, 0, seconds(15), None), ("b1", 4, 0, None, "accepted")]
    s, a = spark.createDataFrame(sends, SENDS), spark.createDataFrame(said, ANSWERS)
    first = answers.first_answers(a)
    joined = answers.deliveries(answers.resolve(s, first, 30), answers.late_answers(s, first, 30, 60))
    for n in (None, 1, 5):
        got = answers.settle(s, a, 30, 60, n)
        assert got.columns == joined.columns and [f.dataType for f in got.schema] == [f.dataType for f in joined.schema]
        assert sorted(got.collect()) == sorted(joined.collect())


def test_a_task_holds_so_many_records_only(spark, sf, monkeypatch):
    """Tasks grow in number and not in size: 1,000 records are dealt out over ten tasks, which nothing coalesces."""
    monkeypatch.setattr(answers, "PART_RECORDS", 100, raising=False)
    held = [r["count"] for r in catalogue.late_deliveries(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 10 and max(held) < 200


def test_attempts_are_resolved_by_so_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(answers, "PART_RECORDS", 100)
    sends, said, n = catalogue._answered(spark, sf)
    held = [r["count"] for r in answers.resolve(answers.dealt(sends, n, *answers.KEYS), said, 30).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == n == 10 and max(held) < 300


def test_outcomes_on_streams_equal_those_of_tables(spark, tmp_path):
    """The same functions on streams: an attempt without an answer comes out when the watermark passes its time."""
    sends, said = made(random.Random(3), 25)
    said = list({x[:3]: x for x in said}.values())  # one for each attempt: of several, a stream takes the first to come
    far = seconds(100_000)
    spark.createDataFrame([*sends, ("end", 0, 0, far)], SENDS).coalesce(1).write.parquet(f"{tmp_path}/sends/1")
    spark.createDataFrame([*said, ("end", 9, 9, far, "accepted")], ANSWERS).coalesce(1).write.parquet(f"{tmp_path}/answers/1")
    s = spark.readStream.schema(SENDS).parquet(f"{tmp_path}/sends/*").withWatermark("sent_at", "2 minutes")
    a = answers.first_answers(spark.readStream.schema(ANSWERS).parquet(f"{tmp_path}/answers/*").withWatermark("answered_at", "2 minutes"))
    resolved, late = plain(sends, said, 30, 60)
    query = answers.resolve(s, a, 30).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    out = {(r["buffer_id"], r["seq"], r["attempt"]): r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").where(F.col("buffer_id") != "end").collect()}
    assert out.keys() == resolved.keys() and {k for k in out if out[k] == "timed_out"} == {k for k in resolved if resolved[k] == "timed_out"}
    query = answers.late_answers(s, a, 30, 60).writeStream.format("parquet").option("path", f"{tmp_path}/late").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["buffer_id"], r["seq"], r["attempt"]) for r in spark.read.parquet(f"{tmp_path}/late").collect()} == set(late)
