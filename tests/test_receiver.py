"""The receiver stream, sinks, and laws that hold for any input."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.operators import audit, clock, delivery, retention
from fieldtally.sinks.base import SendFailed, shipping
from fieldtally.sinks.http import Http
from fieldtally.sinks.jsonl import JsonLines
from fieldtally.sinks.memory import Scripted
from fieldtally.streaming.receiver import Store, allocate_seqs, hold_unsynced, messages_from_files, run_receiver

UUID = "12345678-1234-1234-1234-123456789abc"
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def message(seq, mono, wall, quality, boot="b", value=1.0):
    return json.dumps({"type": "reading", "buffer_id": UUID, "seq": seq, "device_id": "d", "sensor_id": "s", "value": value, "unit": None, "mono_ns": mono, "wall_ns": wall, "boot_id": boot, "ts_quality": quality, "qc_flag": 2, "qc_tests": []})


def land(spark, path, name, messages):
    rows = [("topic", m, 0, i) for i, m in enumerate(messages)]
    spark.createDataFrame(rows, "source string, payload string, arrival_batch long, arrival_pos long").coalesce(1).write.parquet(f"{path}/{name}")
    return f"{path}/*"


def test_exactly_once_over_restarts(spark, tmp_path):
    store, landing = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    glob = land(spark, landing, "a", [message(1, 5, 5, 0), message(2, 10, 1010, 2), "bad"])
    run = lambda: run_receiver(messages_from_files(spark, glob, 1), store, str(tmp_path / "cp")).awaitTermination()
    run()
    land(spark, landing, "b", [message(2, 10, 1010, 2, value=9.0), message(3, 3, 1103, 2), message(4, 7, 7, 0)])
    run()
    run()
    rows = {r["seq"]: r for r in store.readings().collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[2]["value"] == 1.0
    assert (rows[1]["wall_ns"], rows[1]["ts_quality"]) == (1005, 1)  # by the clock known then
    assert rows[4]["wall_ns"] == 1107  # by the better clock of its own batch
    assert {r["seq"]: r["wall_ns"] for r in store.readings("converged").collect()}[1] == 1105
    assert store.table("dead_letters").count() == 1
    before = sorted(map(tuple, store.table("readings").select("seq", "value").collect()))
    store.store(spark.createDataFrame([("t", message(2, 10, 1010, 2, value=9.0), 0), ("t", message(3, 3, 1103, 2), 1), ("t", message(4, 7, 7, 0), 2)], "source string, payload string, arrival_pos long"), 1)
    assert sorted(map(tuple, store.table("readings").select("seq", "value").collect())) == before


def stream(spark, tmp_path, rows, schema, f, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_seqs_are_never_reissued(spark, tmp_path):
    kind, f = "buffer_id string, run long, pos long", lambda df: allocate_seqs(df, 10)
    stream(spark, tmp_path, [("a", 1, i) for i in range(12)] + [("b", 1, 0)], kind, f, "q")
    got = stream(spark, tmp_path, [("a", 2, i) for i in range(3)] + [("a", 1, 99)][:0], kind, f, "q")
    assert sorted(r["seq"] for r in got if r["buffer_id"] == "a") == [*range(12), 20, 21, 22]


def test_hold_waits_for_a_clock(spark, tmp_path):
    kind = "boot_id string, buffer_id string, seq long, mono_ns long, wall_ns long, ts_quality int"
    f = lambda df: hold_unsynced(df, None)
    assert stream(spark, tmp_path, [("x", "a", 1, 5, 5, 0), ("y", "a", 2, 6, 6, 0)], kind, f, "h") == []
    got = stream(spark, tmp_path, [("x", "a", 3, 10, 1010, 2)], kind, f, "h")
    assert sorted((r["seq"], r["offset_ns"]) for r in got) == [(1, 1000), (3, 1000)]


def test_shipping_resends_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(i, UUID, "d", "s") for i in range(6)], "seq long, buffer_id string, device_id string, sensor_id string")
    done = []
    sink = Scripted([None, "'rejected'", "CASE WHEN seq % 2 = 0 THEN 'accepted' END", "CASE WHEN seq = 3 THEN 'rejected' ELSE 'accepted' END"])
    shipping(sink, lambda df, _: done.extend((r["seq"], r["outcome"]) for r in df.collect()), sleep=lambda s: None)(rows, 0)
    assert sorted(done) == [(0, "accepted"), (1, "accepted"), (2, "accepted"), (3, "rejected"), (4, "accepted"), (5, "accepted")]
    with pytest.raises(SendFailed):
        shipping(Scripted([], None), lambda *_: None, attempts=2, sleep=lambda s: None)(rows, 1)
    lines = JsonLines(str(tmp_path / "lines"))
    for _ in range(2):
        lines.send(rows, 7)
    assert spark.read.text(str(tmp_path / "lines")).count() == 6


def test_http_sink(spark):
    def fake(url, body, headers):
        import gzip

        seqs = [r["seq"] for r in json.loads(gzip.decompress(body))["records"]]
        return 207, json.dumps({"accepted": [x for x in seqs if x != 4], "rejected": [x for x in seqs if x == 4]}).encode()

    rows = spark.createDataFrame([(i, UUID, "d", "s") for i in range(6)], "seq long, buffer_id string, device_id string, sensor_id string")
    got = Http("http://x", "d", part_rows=2, send_part=fake).send(rows, 0).collect()
    assert {r["seq"]: r["outcome"] for r in got} == {i: "rejected" if i == 4 else "accepted" for i in range(6)}


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=40), st.integers(1, 12))
def test_retention_conserves(spark, xs, cap):
    rows = spark.createDataFrame([(f"b{b}", i, f"s{s}", "boot", i) for i, (b, s) in enumerate(xs)], "buffer_id string, seq long, sensor_id string, boot_id string, mono_ns long")
    kept, gone = retention.survivors(rows, cap), retention.evicted(rows, cap)
    assert all(r["holds"] and r["kept"] <= cap for r in audit.conservation(rows, kept, retention.gap_summary(gone, "r", "buffer_id")).collect())
    for b in range(3):
        mine = [i for i, (x, _) in enumerate(xs) if x == b]
        assert sorted(r["seq"] for r in kept.where(F.col("buffer_id") == f"b{b}").collect()) == mine[-cap:]


def test_ranks_over_parts(spark):
    rows = spark.range(100).select(F.lit("b").alias("buffer_id"), (F.col("id") * 7).alias("seq"))
    got = retention.with_rank(rows, part_rows=50).collect()
    assert all(r["nth"] == r["seq"] // 7 + 1 for r in got)
    assert all(r["nth"] == 100 - r["seq"] // 7 for r in retention.with_rank(rows, descending=True, part_rows=50).collect())


def sequential(rows):
    """A receiver that looks at each batch once, by hand."""
    clocks, stored = {}, {}
    for batch in sorted({r[0] for r in rows}):
        new = [r for r in sorted(rows) if r[0] == batch]
        for _, pos, seq, boot, mono, wall, q in new:
            stored[seq] = [boot, mono, wall, q]
            if q and (boot not in clocks or mono < clocks[boot][0]):
                clocks[boot] = (mono, wall - mono)
        for r in stored.values():
            if r[3] == 0 and r[0] in clocks and any(x[3] == r[0] for x in new):
                r[2], r[3] = r[1] + clocks[r[0]][1], 1
    return {seq: (r[2], r[3]) for seq, r in stored.items()}


@pytest.mark.parametrize("seed", range(4))
def test_correction_by_arrival_is_what_a_receiver_does(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(60):
        mono, q = rng.randrange(1000), rng.choice([0, 0, 2])
        rows.append((rng.randrange(8), seq, seq, f"b{rng.randrange(3)}", mono, mono + 5000 + rng.randrange(50) if q else mono, q))
    df = spark.createDataFrame([("x", *r) for r in rows], "buffer_id string, arrival_batch long, arrival_pos long, seq long, boot_id string, mono_ns long, wall_ns long, ts_quality int")
    got = {r["seq"]: (r["wall_ns"], r["ts_quality"]) for r in clock.correct_by_arrival(df).collect()}
    assert got == sequential(rows)


@FEW
@given(st.lists(st.integers(0, 3), max_size=8))
def test_states_follow_the_rules(spark, moves):
    state = 0
    for to in moves:
        if (state, to) in {(0, 1), (1, 0), (1, 2), (1, 3)}:
            state = to
    rows = spark.createDataFrame([("b", 1, i, to) for i, to in enumerate(moves)] or [("b", 1, 0, 0)], "buffer_id string, id long, pos long, to_state int")
    assert delivery.states(rows).first()["state"] == state


def test_audits_find_what_is_planted(spark):
    committed = spark.range(10).select(F.col("id").alias("step"))
    delivered = spark.createDataFrame([(i, "b", i) for i in range(10) if i != 4] + [(3, "b", 3), (5, "b", 99), (77, "b", 77)], "step long, buffer_id string, seq long")
    row = audit.loss_report(committed, delivered).first()
    assert (row["committed"], row["delivered"], row["redelivered"], row["lost"], row["duplicates_after_dedupe"], row["unknown"]) == (10, 12, 1, 1, 1, 1)
    assert [r["step"] for r in audit.lost(committed, delivered, "step").collect()] == [4]


def test_broker_subscription(spark, tmp_path):
    from fieldtally.sources.broker import BrokerSource

    spark.dataSource.register(BrokerSource)
    log, store = tmp_path / "log", Store(spark, str(tmp_path / "store"))
    log.write_text("\n".join([message(i, i, 1000 + i, 2) for i in range(25)] + ["bad"]) + "\n")
    subscribe = lambda: spark.readStream.format("broker").option("client", "fieldtally.sources.broker:FileLog").option("log", str(log)).option("part_rows", 10).load()
    for expected in (25, 27):
        run_receiver(subscribe(), store, str(tmp_path / "checkpoint")).awaitTermination()
        assert store.table("readings").count() == expected
        with log.open("a") as f:  # one again and two new ones
            f.write("\n".join(message(i, i, 1000 + i, 2) for i in (3, 25, 26)) + "\n")
    last = store.totals().orderBy(F.col("arrival_batch").desc()).first()
    assert (last["messages"], last["readings"], last["duplicates"], last["dead_letters"]) == (29, 27, 1, 1)


def test_mqtt_publishes_each_record(spark, tmp_path):
    from fieldtally.sinks.mqtt import Mqtt

    path = str(tmp_path / "sent")

    def connect():
        def publish(topic, payload):
            with open(path, "a") as f:
                f.write(topic + " " + payload.decode() + "\n")
            seq = json.loads(payload)["seq"]
            return [0x00, 0x10, 0x99, 0x80, None][seq % 5]

        return publish

    rows = spark.createDataFrame([("b", i, "d", "s/1") for i in range(10)], "buffer_id string, seq long, device_id string, sensor_id string")
    found = {r["seq"]: r["outcome"] for r in Mqtt(connect).send(rows, 0).collect()}
    assert found == {i: "rejected" if i % 5 == 2 else "accepted" for i in range(10) if i % 5 < 3}
    lines = open(path).read().splitlines()
    assert len(lines) == 10 and all(x.startswith("d/b/reading/s%2F1 {\"device_id\":\"d\"") for x in lines)


def test_uuids_are_read_as_python_reads_them(spark):
    import uuid

    from fieldtally.functions.scalars import canonical_uuid

    texts = [UUID, UUID.upper(), UUID.replace("-", ""), "{" + UUID + "}", "urn:uuid:" + UUID, "URN:UUID:" + UUID, "{" + UUID[:8] + "}" + UUID[8:], "1-" * 31 + "1", "x", ""]

    def own(t):
        try:
            return str(uuid.UUID(t))
        except ValueError:
            return None

    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical_uuid(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in found} == {t: own(t) for t in texts}


def test_lines_and_fakes(spark, tmp_path):
    from fieldtally.sources.tables import fake_readings, lines
    from fieldtally.sources.wire import parse_lines

    path = tmp_path / "in.jsonl"
    path.write_bytes(b'{"sensor_id":"s","value":1.5}\n\n  \n{"sensor_id":"s","value":null,"unit":"C"}\nnope\n{"sensor_id":"s","value":1' + b"0" * 400 + b'}\n{"sensor_id":"s\xed\xa0\x80","value":1}\n{"sensor_id":"t","value":2}')
    found = parse_lines(lines(spark, str(path)))
    assert sorted((r["sensor_id"], r["reading"]) for r in found.where("NOT bad").collect() if r["reading"]) == [("s", 1.5), ("t", 2.0)]
    assert found.where("NOT bad").count() == 3 and found.where("bad").count() == 3
    assert [r["value"] for r in fake_readings(spark, 1, streaming=False, rows=3).orderBy("value").collect()] == [0.0, 1.0, 2.0]


def test_reads_by_device(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    frame = lambda seqs: spark.createDataFrame([("topic", message(i, i, 1000 + i, 2), i) for i in seqs], "source string, payload string, arrival_pos long")
    store.store(frame(range(5)), 0)
    store.store(frame(range(5, 8)), 1)
    seen = lambda: sorted(r["seq"] for r in store.of_device("d", 1003, 1009).collect())
    assert seen() == [3, 4, 5, 6, 7]
    store.compact()
    store.store(frame(range(8, 12)), 2)
    assert seen() == [3, 4, 5, 6, 7, 8, 9] and store.of_device("x", 0, 1 << 60).count() == 0
