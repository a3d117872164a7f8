"""The spool's intake, exactly once, and its kept counters."""

from __future__ import annotations

import json
import random
from pathlib import Path

from fieldtally.__main__ import SPOOLED
from fieldtally.operators import buffer, counters
from fieldtally.sinks.memory import Scripted
from fieldtally.streaming.shipper import Shipper, Spool


def readings(spark, start, n, buffer_id="buf", sensor="s", tests=()):
    rows = [(buffer_id, start + i, "d", sensor, float(start + i), None, start + i, 1000 + start + i, "boot", 2, 2, list(tests)) for i in range(n)]
    return spark.createDataFrame(rows, SPOOLED)


def take_all(spark, spool, landing, checkpoint):
    stream = spark.readStream.schema(SPOOLED).option("maxFilesPerTrigger", 1).parquet(landing)
    stream.writeStream.foreachBatch(spool.intake(checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def contents(spool):
    rows, _, following = spool.load()
    return sorted((r["buffer_id"], r["seq"], r["value"]) for r in rows.collect()), sorted((r["buffer_id"], r["next_seq"]) for r in following.collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    landing, checkpoint = f"{tmp_path}/in", f"{tmp_path}/cp"
    spool = Spool(spark, f"{tmp_path}/spool")
    readings(spark, 0, 6).coalesce(1).write.parquet(f"{landing}/a")
    readings(spark, 6, 4).coalesce(1).write.parquet(f"{landing}/b")
    take_all(spark, spool, f"{landing}/*", checkpoint)
    before, log = contents(spool), [tuple(r) for r in spool.table("intake").collect()]
    assert before[1] == [("buf", 10)] and len(before[0]) == 10 and log[0][1:4] == (1, 10, 0)
    commits = sorted(x for x in Path(checkpoint, "commits").iterdir() if x.name.isdigit())
    for x in (commits[-1], Path(checkpoint, "commits", f".{commits[-1].name}.crc")):  # as after a crash behind the spool's own commit
        x.unlink(missing_ok=True)
    take_all(spark, spool, f"{landing}/*", checkpoint)
    assert contents(spool) == before and [tuple(r) for r in spool.table("intake").collect()] == log
    readings(spark, 10, 1).coalesce(1).write.parquet(f"{landing}/c")
    take_all(spark, spool, f"{landing}/*", checkpoint)
    assert contents(spool)[1] == [("buf", 11)] and spool.table("intake").first()["batch"] == 2


def test_a_batch_cut_short_is_taken_whole_later(spark, tmp_path):
    """A version whose last table isn't whole doesn't count; neither does its log."""
    spool = Spool(spark, f"{tmp_path}/spool")
    assert spool.append(readings(spark, 0, 3), "s", 0)
    half = Path(f"{tmp_path}/spool/v=1")
    readings(spark, 3, 3).write.parquet(f"{half}/rows")
    spark.createDataFrame([("s", 1, 6, 0, 1)], "source string, batch long, taken long, refused long, version long").write.parquet(f"{half}/intake")
    assert spool.version() == 0 and spool.append(readings(spark, 3, 3), "s", 1) and not spool.append(readings(spark, 3, 3), "s", 1)
    assert spool.append(readings(spark, 0, 2), "other", 0)  # another stream has numbers of its own
    assert contents(spool)[1] == [("buf", 8)]


def test_texts_that_cannot_be_stored_are_refused(spark, tmp_path):
    spool = Spool(spark, f"{tmp_path}/spool")
    good = readings(spark, 0, 2, tests=("range",))
    bad = readings(spark, 2, 3).selectExpr(*[f"CAST(X'ff41' AS STRING) AS {c}" if c == "sensor_id" else c for c in good.columns])
    listed = readings(spark, 5, 1).selectExpr(*["array(CAST(X'c328' AS STRING)) AS qc_tests" if c == "qc_tests" else c for c in good.columns])
    spool.append(good.unionByName(bad).unionByName(listed), "s", 0)
    assert contents(spool) == ([("buf", 0, 0.0), ("buf", 1, 1.0)], [("buf", 2)])
    assert spark.read.parquet(f"{tmp_path}/spool/refused").count() == 4 and spool.table("intake").first()["refused"] == 4


def counted(spool):
    kept, again = (counters.fold(x, []) for x in (spool.table("counts"), counters.recount(*spool.load()[:2])))
    return [sorted(map(tuple, x.collect())) for x in (kept, again)]


def test_counters_equal_a_recount_after_random_scripts(spark, tmp_path):
    for seed in range(2):
        rng = random.Random(seed)
        spool = Spool(spark, f"{tmp_path}/spool{seed}", max_rows=14, policy=rng.choice(["drop_oldest", "halt_and_alarm"]), quarantine_rows=2)
        answers = [None, "'accepted'", "IF(seq % 3 = 0, 'rejected', 'accepted')", "'rejected'", "IF(seq % 2 = 0, 'accepted', NULL)"]
        now = [0.0]
        shipper = Shipper(spool, Scripted([rng.choice(answers) for _ in range(9)]), Scripted([rng.choice(answers[:3]) for _ in range(9)]), batch_rows=5, purge_every=3, clock_s=lambda: now[0], told=lambda *x: None)
        at = 0
        for step in range(7):
            if rng.random() < 0.5:
                n = rng.randint(1, 12)
                spool.append(readings(spark, at, n, rng.choice("ab"), rng.choice("st")))
                at += n
            else:
                shipper.once()
            kept, again = counted(spool)
            assert kept == again, (seed, step)
        old = buffer.status(*spool.load()[:2], 14, spool.policy, 0).drop("file_bytes")
        assert sorted(map(str, spool.status().select(old.columns).collect())) == sorted(map(str, old.collect()))


def test_a_spool_without_counters_is_counted_once(spark, tmp_path):
    spool = Spool(spark, f"{tmp_path}/spool")
    spool.append(readings(spark, 0, 4))
    import shutil

    shutil.rmtree(f"{tmp_path}/spool/v=0/counts")
    spool.append(readings(spark, 4, 2))
    assert json.loads(spool.table("counts").toJSON().first())["n"] == 6 and counted(spool)[0] == counted(spool)[1]
