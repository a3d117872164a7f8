"""Buffers under a cap, moves of claimed rows, and shipping, against a plain model."""

from __future__ import annotations

import json
import random

import pytest

from fieldtally.__main__ import SPOOLED, main
from fieldtally.operators import buffer
from fieldtally.schemas import ACKED, INFLIGHT, PENDING, REJECTED
from fieldtally.sinks.base import SendFailed
from fieldtally.sinks.memory import Scripted
from fieldtally.streaming.shipper import Shipper, Spool

COLUMNS = "buffer_id string, seq long, state int, sensor_id string, boot_id string, mono_ns long"


def table(spark, rows):
    return spark.createDataFrame([(b, i, s, f"s{i % 2}", "boot", i * 10) for b, i, s in rows], COLUMNS).repartition(3)


def states(df):
    return {(r["buffer_id"], r["seq"]): r["state"] for r in df.collect()}


def test_eviction_spares_what_is_in_flight(spark):
    held = table(spark, [("a", i, INFLIGHT) for i in range(8)] + [("a", i, PENDING) for i in (8, 9)])
    kept, gaps = buffer.append(held, table(spark, [("a", i, 0) for i in range(10, 15)]).drop("state"), 10)
    assert sorted(i for _, i in states(kept)) == [*range(8), 13, 14]
    assert sum(r["count"] for r in gaps.collect()) == 5


@pytest.mark.parametrize("policy", ["drop_oldest", "halt_and_alarm"])
def test_append_matches_a_plain_model(spark, policy):
    rng = random.Random(21)
    held = [(b, i, rng.choice([PENDING, PENDING, INFLIGHT, ACKED, REJECTED])) for b in "abcd" for i in range(rng.randint(0, 30))]
    coming = [(b, 100 + i, 0) for b in "abce" for i in range(rng.randint(1, 12))]
    cap, expected, lost = 16, {}, 0
    for b in "abcde":
        mine, new = [x for x in held if x[0] == b], [x for x in coming if x[0] == b]
        over = max(0, sum(s in (PENDING, INFLIGHT) for *_, s in mine) + len(new) - cap) if new else 0
        if policy == "halt_and_alarm":
            gone = new if over else []
        else:
            pending = sorted(x for x in mine if x[2] == PENDING)
            gone = pending[:over] + sorted(new)[: max(0, over - len(pending))]
        lost += len(gone)
        expected |= {(x, i): s for x, i, s in mine + new if (x, i, s) not in gone}
    kept, gaps = buffer.append(table(spark, held), table(spark, coming).drop("state"), cap, policy)
    assert states(kept) == expected and sum(r["count"] for r in gaps.collect()) == lost > 0


def test_moves(spark):
    rows = table(spark, [("a", i, PENDING) for i in range(10)])
    claimed = buffer.claim(rows, 4)
    assert {i for (_, i), s in states(claimed).items() if s == INFLIGHT} == {0, 1, 2, 3}
    ids = table(spark, [("a", 1, 0), ("a", 2, 0), ("a", 7, 0), ("b", 3, 0)])
    assert {i for (_, i), s in states(buffer.release(claimed, ids)).items() if s == INFLIGHT} == {0, 3}
    refused, gaps = buffer.reject(claimed, ids)
    assert {i for (_, i), s in states(refused).items() if s == REJECTED} == {1, 2} and sum(r["count"] for r in gaps.collect()) == 2
    assert set(states(buffer.recover(claimed)).values()) == {PENDING}
    quarantined = table(spark, [("a", i, REJECTED) for i in range(8)] + [("a", 8 + i, ACKED) for i in range(5)])
    left, _ = buffer.purge(quarantined, table(spark, []), 2, 3)
    assert sorted(i for _, i in states(left)) == [5, 6, 7, 10, 11, 12]


def fill(spark, spool, start, n, quality=2):
    rows = [("buf", start + i, "d", "s", float(start + i), None, start + i, 1000 + start + i if quality else start + i, "boot", quality, 2, []) for i in range(n)]
    spool.append(spark.createDataFrame(rows, SPOOLED))


class Ledger(Scripted):
    """Remembers what was accepted."""

    def __init__(self, *args):
        super().__init__(*args)
        self.got = []

    def send(self, batch, batch_id):
        answers = super().send(batch, batch_id)
        yes = {r["seq"] for r in answers.where("outcome = 'accepted'").collect()}
        self.got += [r.asDict() for r in batch.collect() if r["seq"] in yes]
        return answers


def test_shipping_accounts_for_every_reading(spark, tmp_path):
    spool = Spool(spark, str(tmp_path / "spool"), max_rows=30)
    fill(spark, spool, 0, 20, quality=0)
    fill(spark, spool, 20, 20)
    readings, gaps = Ledger([None, "IF(value % 7 = 0, 'rejected', 'accepted')", "'rejected'", "IF(seq % 2 = 0, 'accepted', NULL)"]), Ledger([None])
    now, pauses = [0.0], []
    shipper = Shipper(spool, readings, gaps, batch_rows=12, hold_s=5, purge_every=2, clock_s=lambda: now[0])
    shipper.run(5, sleep=pauses.append)
    counted = sum(r["count"] for r in gaps.got)
    assert len(readings.got) + counted == 40 and len({r["seq"] for r in readings.got} | {r["seq"] for r in gaps.got}) == len(readings.got) + len(gaps.got)
    assert {r["reason"] for r in gaps.got} == {"retention:drop_oldest", "rejected:sink"}
    assert all(r["ts_quality"] > 0 and r["wall_ns"] == 1000 + r["mono_ns"] for r in readings.got)
    status = spool.status().first()
    assert (status["pending"], status["inflight"], status["unshipped_gaps"], status["cap"], status["policy"]) == (0, 0, 0, 30, "drop_oldest") and status["file_bytes"] > 0
    assert len(pauses) >= 2 and shipper.once() == "empty"


def test_readings_wait_for_a_clock(spark, tmp_path):
    spool = Spool(spark, str(tmp_path / "spool"))
    fill(spark, spool, 0, 3, quality=0)
    now, sink = [0.0], Ledger([])
    shipper = Shipper(spool, sink, Ledger([]), hold_s=5, clock_s=lambda: now[0])
    assert shipper.once() == "empty" and not sink.got
    now[0] = 6.0
    assert shipper.once() == "progress" and [r["ts_quality"] for r in sink.got] == [0, 0, 0]


def test_a_refused_gap_is_told(spark, tmp_path):
    spool, told = Spool(spark, str(tmp_path / "spool"), max_rows=2), []
    fill(spark, spool, 0, 5)
    shipper = Shipper(spool, Ledger([]), Ledger(["'rejected'"]), told=lambda *x: told.append(x))
    assert shipper.once() == "progress" and told == [("buf", 1, 3)]
    shipper.run(1)
    assert spool.status().first()["unshipped_gaps"] == 0
    with pytest.raises(SendFailed):
        fill(spark, spool, 9, 1)
        Shipper(spool, Ledger([], None), Ledger([])).run(1, sleep=lambda s: None)


def test_ship_command(spark, tmp_path, capsys):
    rows = [("buf", i, "d", "s", float(i), None, i, 1000 + i, "boot", 2, 2, []) for i in range(9)]
    spark.createDataFrame(rows, SPOOLED).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    config = tmp_path / "c.toml"
    config.write_text(f'[input]\npath = "{tmp_path}/in/*"\n[storage]\npath = "{tmp_path}/spool"\ncheckpoint = "{tmp_path}/cp"\n[retention]\nmax_rows = 6\n[shipping]\npath = "{tmp_path}/out"\nhold_s = 0.0\n')
    assert main(["ship", str(config)]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found[0]["unacked"] == 0 and found[0]["discarded_in_buffered_gaps"] == 3
    assert spark.read.text(f"{tmp_path}/out/reading").count() == 6 and json.loads(spark.read.text(f"{tmp_path}/out/gap").first()[0])["count"] == 3
    assert main(["ship", str(config)]) == 0 and spark.read.text(f"{tmp_path}/out/reading").count() == 6
