"""Where telemetry comes in and goes out: receive logs, MQTT answers, the stream sink, rows that a storage refuses."""

from __future__ import annotations

import builtins
import json
import threading
from pathlib import Path

import pytest

from fieldtally.__main__ import main
from fieldtally.config import ConfigError, parse
from fieldtally.sinks.mqtt import Acks, Connection, Mqtt
from fieldtally.sinks.stream import ShippingSink, outcomes_of
from fieldtally.sources.broker import BrokerReader, FileLog
from fieldtally.streaming.receiver import Store, hold_unsynced, isolated
from test_receiver import message
from test_store import state, take


def test_a_log_is_read_once(tmp_path, monkeypatch):
    log, read = tmp_path / "log", []
    log.write_text("".join(f"m{i}\n" for i in range(5000)) + "half")
    client = FileLog({"log": str(log)})
    assert client.end() == 5000 and client.end() == 5000

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def __iter__(self):
            return self

        def __next__(self):
            read.append(1)
            return next(self.f)

        def __getattr__(self, name):
            return getattr(self.f, name)

    monkeypatch.setattr(builtins, "open", lambda *a, f=builtins.open, **k: Counted(f(*a, **k)) if a[0] == str(log) else f(*a, **k))
    assert [p for _, p in client.read(4100, 4103)] == ["m4100", "m4101", "m4102"] and len(read) <= 103
    monkeypatch.undo()
    with log.open("a") as f:
        f.write(" more\nlast\n")
    assert client.end() == 5002 and [p for _, p in client.read(4999, 5002)] == ["m4999", "half more", "last"]
    client.forget(3500)
    FileLog._SEEN.clear()
    again = FileLog({"log": str(log)})
    assert again.marks == [(3000, sum(len(f"m{i}\n") for i in range(3000)))] and again.end() == 5002
    assert [p for _, p in again.read(3500, 3502)] == ["m3500", "m3501"]
    with pytest.raises(ValueError, match="forgotten"):
        again.read(10, 11)


class Growing:
    """A client to which messages come by a script of ends."""

    ends: list[int] = []

    def __init__(self, options):
        pass

    def end(self):
        return self.ends.pop(0) if len(self.ends) > 1 else self.ends[0]


def test_a_batch_ends_by_size_deadline_or_lull():
    reader = lambda **more: BrokerReader({"client": "test_edges:Growing", "max_delay_s": "5", "batch_size": "10", "lull_s": "0.01", **more})
    Growing.ends = [0, 0, 3, 6, 12, 20]
    some = reader()
    assert some.latestOffset() == {"place": 12}  # enough
    Growing.ends = [13, 15, 15, 99]
    assert some.latestOffset() == {"place": 15}  # a lull
    Growing.ends = [0]
    assert reader(max_delay_s="0.05").latestOffset() == {"place": 0}  # nothing came in time
    Growing.ends = [7, 8]
    assert reader(max_delay_s="0").latestOffset() == {"place": 7}


def test_late_answers_vouch_for_nothing():
    acks = Acks()
    acks.answered(1, 0)
    threading.Timer(0.05, lambda: acks.answered(2, 0x87)).start()
    assert acks.wait([1, 2, 3], 0.4) == [0, 0x87, None]
    acks.answered(3, 0)  # too late: forgotten, once
    assert acks.wait([3], 0.01) == [None]
    acks.answered(3, 0)
    acks.answered(3, 0x10)
    assert acks.wait([3], 0.01) == [0x10]


def disconnecting():
    """Publishes three messages, answers two, and then is disconnected."""
    acks, sent = Acks(), []

    def publish(topic, payload):
        if len(sent) == 3:
            return None
        sent.append(topic)
        if len(sent) != 2:
            acks.answered(len(sent), 0)
        return len(sent)

    return Connection(publish, acks)


def test_a_disconnected_client_refuses(spark):
    rows = spark.createDataFrame([("b", i, "d", "s") for i in range(6)], "buffer_id string, seq long, device_id string, sensor_id string").coalesce(1)
    found = {r["seq"]: r["outcome"] for r in Mqtt(disconnecting, ack_timeout_s=0.05).send(rows, 0).collect()}
    assert found == {0: "accepted", 2: "accepted"}


def test_mqtt_settings(tmp_path, capsys):
    with pytest.raises(ConfigError, match="shipping.host must be set"):
        parse('[shipping]\nsink = "mqtt"\n')
    assert parse('[shipping]\nsink = "mqtt"\nhost = "broker"\nport = 8883\ntls = "on"\n').shipping.port == 8883
    with pytest.raises(ConfigError, match="tls must be one of"):
        parse('[shipping]\nsink = "mqtt"\nhost = "x"\ntls = "maybe"\n')


def sender(options):
    def send(rows):
        if any(r["seq"] == 13 for r in rows) and not Path(options["flag"]).exists():
            Path(options["flag"]).touch()
            raise RuntimeError("killed")
        if any(r["seq"] >= 20 for r in rows):
            raise OSError("no network")
        return [(r["buffer_id"], r["seq"], "rejected" if r["seq"] % 5 == 0 else "accepted") for r in rows if r["seq"] % 7]

    return send


def test_a_stream_sink_counts_committed_tasks_alone(spark, tmp_path):
    spark.dataSource.register(ShippingSink)
    for k in range(2):
        spark.range(12 * k, 12 * k + 12).selectExpr("'b' AS buffer_id", "id AS seq").repartition(3).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("buffer_id string, seq long").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/*")
    run = lambda: rows.writeStream.format("shipping").option("sender", "test_edges:sender").option("ledger", f"{tmp_path}/ledger").option("flag", f"{tmp_path}/flag").option("part_rows", 1).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    found = [(r["seq"], r["outcome"]) for r in outcomes_of(spark, f"{tmp_path}/ledger").collect()]
    expected = {s: "released" if s >= 20 or s % 7 == 0 else "rejected" if s % 5 == 0 else "accepted" for s in range(24)}
    assert len(found) == 24 and dict(found) == expected
    totals = [json.loads(x.read_text()) for x in Path(f"{tmp_path}/ledger/batches").glob("*.json")]
    assert sum(t["accepted"] for t in totals) == sum(o == "accepted" for o in expected.values())


class Picky(Store):
    """A storage with a constraint of its own."""

    def _stores(self, part, name):
        if name == "readings" and part.where("value > 900").limit(1).count():
            raise ValueError("value violates a constraint\nDETAIL: ...")


def test_a_row_that_the_storage_refuses_costs_itself(spark, tmp_path):
    store = Picky(spark, f"{tmp_path}/store")
    take(spark, store, 0, [message(i, 5 + i, 1005 + i, 2, value=1000.0 if i in (3, 17) else 1.0) for i in range(30)])
    assert len(state(store)) == 28 and {s for _, s, _, _ in state(store)}.isdisjoint({3, 17})
    bad = store.table("refused").collect()
    assert {json.loads(r["payload"])["seq"] for r in bad} == {3, 17} and {r["error"] for r in bad} == {"value violates a constraint"}
    assert store._stored("readings", 1).count() == 3  # three runs: what was refused may come again

    def out(part):
        raise OSError("no storage")

    with pytest.raises(OSError):
        isolated(spark.createDataFrame([("b", 1)], "buffer_id string, seq long"), out)


HOLD = "boot_id string, buffer_id string, seq long, mono_ns long, wall_ns long, ts_quality int"


def test_a_hold_ends_by_its_timer(spark, tmp_path):
    """Without a trusted reading, what waits comes out when the hold is over; what comes later doesn't wait."""
    import time

    spark.createDataFrame([("x", "a", i, i, i, 0) for i in range(5)], HOLD).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    rows = spark.readStream.schema(HOLD).parquet(f"{tmp_path}/in/*")
    query = hold_unsynced(rows, 1500).writeStream.format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        out = lambda: sorted((r["seq"], r["offset_ns"]) for r in spark.table("held").collect())
        deadline = time.monotonic() + 120
        while len(out()) < 5 and time.monotonic() < deadline:
            time.sleep(0.3)
        assert out() == [(i, None) for i in range(5)]
        spark.createDataFrame([("x", "a", 5, 5, 5, 0)], HOLD).coalesce(1).write.parquet(f"{tmp_path}/in/1")
        while len(out()) < 6 and time.monotonic() < deadline:
            time.sleep(0.3)
        assert out()[-1] == (5, None)
    finally:
        query.stop()


def test_much_that_waits_is_appended_and_comes_out_whole(spark, tmp_path):
    """Batches add to what waits; the trusted reading lets all of it go."""
    for k in range(3):
        spark.range(4000 * k, 4000 * k + 4000).selectExpr("'x' AS boot_id", "'a' AS buffer_id", "id AS seq", "id AS mono_ns", "id AS wall_ns", "0 AS ts_quality").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run = lambda: hold_unsynced(spark.readStream.schema(HOLD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), None).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    run()
    assert spark.read.schema("seq long").parquet(f"{tmp_path}/out").count() == 0
    spark.createDataFrame([("x", "a", 12000, 12000, 13000, 2)], HOLD).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 12001 == got.select("seq").distinct().count() and {r[0] for r in got.select("offset_ns").distinct().collect()} == {1000}
