"""The receiver's store: deduplication by interval sets and corrections of touched boots, against sequential models."""

from __future__ import annotations

import os
import random
from pathlib import Path

from pyspark.sql import functions as F

from fieldtally.operators import clock, intervals
from fieldtally.streaming.receiver import Store
from test_receiver import message

MESSAGES = "source string, payload string, arrival_pos long"


def take(spark, store, batch, payloads):
    store.store(spark.createDataFrame([("t", p, i) for i, p in enumerate(payloads)], MESSAGES).coalesce(1), batch)


def state(store):
    return sorted((r["boot_id"], r["seq"], r["wall_ns"], r["ts_quality"]) for r in store.readings().collect())


def test_intervals_equal_sets(spark):
    rng = random.Random(1)
    keys = [(f"b{rng.randrange(3)}", rng.randrange(60)) for _ in range(150)]
    table = spark.createDataFrame(keys, "buffer_id string, seq long")
    parts = [intervals.interval_set(table.where(F.col("seq") % 3 == k), 16) for k in range(3)]
    whole = intervals.union(intervals.union(parts[0], parts[1]), parts[2])
    other = intervals.union(parts[2], intervals.union(parts[1], parts[0]))
    rows = sorted(map(tuple, whole.select("buffer_id", "part", "low", "high").collect()))
    assert rows == sorted(map(tuple, other.select("buffer_id", "part", "low", "high").collect())) == sorted(map(tuple, intervals.interval_set(table, 16).select("buffer_id", "part", "low", "high").collect()))
    assert {(b, s) for b, _, low, high in rows for s in range(low, high + 1)} == set(keys)
    every = spark.createDataFrame([(f"b{i}", s) for i in range(3) for s in range(60)], "buffer_id string, seq long")
    for few in (0, 1000):
        assert {tuple(r) for r in intervals.outside(every, whole, 16, few).collect()} == {(f"b{i}", s) for i in range(3) for s in range(60)} - set(keys)
    sizes = {r["buffer_id"]: r for r in intervals.size(whole).collect()}
    for b, r in sizes.items():
        mine = sorted({s for x, s in keys if x == b})
        assert (r["n"], r["intervals"], r["low"], r["high"]) == (len(mine), sum(s - 1 not in mine for s in mine), mine[0], mine[-1])
        assert r["missing"] == mine[-1] - mine[0] + 1 - len(mine)


def test_corrections_equal_those_of_one_look_at_each_batch(spark, tmp_path):
    rng = random.Random(7)
    store, seen, seq = Store(spark, f"{tmp_path}/store", buckets=5), [], 0
    for batch in range(6):
        payloads = []
        for _ in range(rng.randint(0, 14)):
            boot, quality, mono = f"boot{rng.randrange(7)}", rng.choice([0, 0, 0, 2]), rng.randrange(1, 10_000)
            payloads.append(message(seq, mono, mono if quality == 0 else mono + 1_000_000 + rng.randrange(50), quality, boot))
            seq += 1
        again = rng.sample(seen, min(len(seen), 4))
        take(spark, store, batch, payloads + again)
        seen += payloads
        if batch == 3:  # as after a crash behind the last write
            before = state(store)
            take(spark, store, batch, payloads + again)
            assert state(store) == before
    rows = store.table("readings")
    expected = sorted((r["boot_id"], r["seq"], r["wall_ns"], r["ts_quality"]) for r in clock.correct_by_arrival(rows).collect())
    assert state(store) == expected and len(expected) == seq
    totals = store.totals().orderBy(F.desc("arrival_batch")).first()
    assert totals["readings"] == seq and totals["duplicates"] > 0


def test_a_batch_reads_no_history(spark, tmp_path):
    """What a batch reads and rewrites of what was stored doesn't grow with the number of batches."""
    store, size = Store(spark, f"{tmp_path}/store", buckets=4), {}
    for batch in range(12):
        take(spark, store, batch, [message(3 * batch + i, 5 + i, 1005 + i, 2, f"boot{batch}") for i in range(3)] + ([message(0, 5, 5, 2)] if batch else []))
        size[batch] = store._stored("readings", batch + 1).count()
    assert set(size.values()) == {1} and store.table("readings").count() == 36
    held = store._stored("readings", 12)
    assert held.inputFiles() and all("/readings_stored/" in x for x in held.inputFiles())
    assert len([x for x in os.listdir(f"{tmp_path}/store/readings_stored") if x.startswith("upto=")]) == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", buckets=8)
    take(spark, store, 0, [message(i, 5 + i, 5 + i, 0, f"boot{i}") for i in range(20)])
    first = {x.name for x in Path(f"{tmp_path}/store/corrected/upto=0").iterdir() if x.name.startswith("bucket=")}
    take(spark, store, 1, [message(100, 9, 1009, 2, "boot3")])
    wrote = {x.name for x in Path(f"{tmp_path}/store/corrected/upto=1").iterdir() if x.name.startswith("bucket=")}
    assert len(first) > 3 and len(wrote) == 1
    fixed = {s: (w, q) for b, s, w, q in state(store)}
    assert fixed[3] == (1008, 1) and fixed[4] == (9, 0) and len(fixed) == 21
    take(spark, store, 2, [message(100, 9, 1009, 2, "boot3"), "bad"])  # nothing new
    assert len(state(store)) == 21


def test_a_store_without_sets_is_read_once(spark, tmp_path):
    import shutil

    store = Store(spark, f"{tmp_path}/store")
    take(spark, store, 0, [message(i, 5 + i, 1005 + i, 2) for i in range(4)])
    shutil.rmtree(f"{tmp_path}/store/readings_stored")
    take(spark, store, 1, [message(i, 5 + i, 1005 + i, 2) for i in range(6)])
    assert store.table("readings").count() == 6 and len(state(store)) == 6


def test_runs_are_merged_in_tiers(spark, tmp_path):
    """What is read by device stays the same, runs stay few, and a row is written once for each level."""
    store, written = Store(spark, f"{tmp_path}/store"), 0

    def finished(batch, seqs):
        rows = [(f"d{s % 2}", s, 1000 + s) for s in seqs]
        store._write(spark.createDataFrame(rows, "device_id string, seq long, wall_ns long").coalesce(1), "readings", batch)
        store._write(spark.createDataFrame([(len(rows),)], "readings long").coalesce(1), "batches", batch)

    store.compact()  # nothing there
    for batch in range(9):
        finished(batch, range(3 * batch, 3 * batch + 3))
        before = store.of_device("d1", 1004, 1900)
        store.compact(file_rows=4, ways=3)
        version, runs = store._layout()
        written += next(r["rows"] for r in runs if r["name"] == f"run-{version}")
        assert version == batch and max(r["high"] for r in runs) == batch and sum(r["rows"] for r in runs) == 3 * batch + 3
        assert all(sum(r["level"] == x for r in runs) < 3 for x in range(4))
        for found in (before, store.of_device("d1", 1004, 1900)):  # one that was planned before is still right
            assert sorted(r["seq"] for r in found.collect()) == list(range(5, 3 * batch + 3, 2))
    assert [(r["level"], r["rows"]) for r in runs] == [(2, 27)] and written == 6 * 3 + 2 * 9 + 27
    assert len(os.listdir(f"{tmp_path}/store/runs")) <= 6
    store.compact()  # nothing new
    assert store._layout()[0] == 8
    finished(9, [])
    store.compact(ways=3)
    assert sorted(r["rows"] for r in store._layout()[1]) == [0, 27] and store.of_device("d0", 0, 1 << 60).count() == 14
    assert not any("/runs/" in x for x in store.of_device("d1", 2000, 3000).inputFiles())
