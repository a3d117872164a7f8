"""The sequential folds against plain loops, over parts smaller than a buffer."""

from __future__ import annotations

import random

import pytest

from fieldtally.operators import delivery, retention


def test_next_commit_of_every_row():
    import numpy as np

    t = np.array([0, 1, 9, 3, 12, 12])
    assert retention.next_commits(t, np.ones(6, bool), 3, 9).tolist() == [2, 2 + 2, 5, 4, 7, 8]


@pytest.mark.parametrize("max_rows", [1, 3])
def test_flushes_over_parts(spark, max_rows):
    rng = random.Random(5)
    writes = [(b, i * 2, rng.choice([None, *range(0, 40)])) for b, n in (("a", 50), ("b", 7), ("c", 1)) for i in range(n)]
    expected, state = set(), {}
    for b, pos, t in writes:
        n, last = state.get(b, (0, None))
        n += 1
        if n >= max_rows or last is None or (t is not None and t - last >= 20):
            expected.add((b, pos, n))
            n, last = 0, t
        state[b] = n, last
    table = spark.createDataFrame(writes, "buffer_id string, pos long, t long")
    found = retention.flushes(table, max_rows, 20, part_rows=5)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_halted_batches_hold_no_array(spark):
    rng = random.Random(6)
    batches = [(b, k, rng.randint(0, 50), rng.randint(0, 30)) for b in "abc" for k in range(40)]
    expected, used = [], {}
    for b, k, n, acked in batches:
        free = max(0, used.get(b, 0) - acked)
        used[b] = free + n if free + n <= 60 else free
        expected.append((b, k, n, free + n <= 60, used[b]))
    found = retention.halted_batches(spark.createDataFrame(batches, "buffer_id string, batch long, n long, acked long").repartition(5), 60)
    assert sorted(map(tuple, found.collect())) == expected
    assert "collect_list" not in found._jdf.queryExecution().toString()


def held_one_by_one(batches, cap):
    expected, used = [], {}
    for b, k, n, acked in batches:
        now = 0 if acked is None else max(0, used.get(b, 0) - acked)
        fits = None if n is None else now + n <= cap
        used[b] = now + n if fits else now
        expected.append((b, k, n, fits, used[b]))
    return expected


@pytest.mark.parametrize("cap, most", [(60, 4096), (60, 3), (700, 4), (0, 4096), (10_000, 4096)])
def test_halted_batches_over_parts(spark, cap, most):
    rng = random.Random(cap + most)
    batches = [(b, k, rng.choice([0, rng.randint(0, 50), rng.randint(0, 9)]), rng.choice([0, 0, rng.randint(0, 30)])) for b in "abc" for k in range(130 if b == "a" else 40)]
    batches[50], batches[61], batches[70], batches[75] = ("a", 50, None, 3), ("a", 61, 5, None), ("a", 70, -2, 4), ("a", 75, 5, -6)
    table = spark.createDataFrame(batches, "buffer_id string, batch long, n long, acked long").repartition(5)
    found = retention.halted_batches(table, cap, part_batches=12, most=most)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, found.collect()), key=key) == held_one_by_one(batches, cap)


def test_halted_batches_without_ids(spark):
    batches = [(None, None, 30, 0), (None, 0, 40, 0), (None, 30, 20, 0), (None, 30, 20, 0), (None, 61, 7, 0)]
    table = spark.createDataFrame(batches, "buffer_id string, batch long, n long, acked long")
    found = sorted((r["batch"] or -1, r["n"], r["accepted"], r["used"]) for r in retention.halted_batches(table, 60, 10).collect())
    assert found == [(-1, 30, True, 30), (-1, 40, False, 30), (30, 20, False, 50), (30, 20, True, 50), (61, 7, True, 57)]
    assert retention.halted_batches(table.limit(0), 60, 10).count() == 0


def test_maps_of_batches_equal_their_fold():
    """The map of some batches, for every number of rows in use, and no more pieces than batches."""
    rng = random.Random(8)
    for _ in range(60):
        cap, most = rng.randrange(0, 90), rng.choice([2, 6, 4096])
        batches = [(rng.choice([None, rng.randrange(0, 60), rng.randrange(0, 9)]), rng.choice([0, 0, rng.randrange(0, 25)])) for _ in range(rng.randrange(1, 60))]
        rows = list(retention._maps(iter(batches), cap, most))
        assert len(rows) <= len(batches)
        for start in range(cap + 1):
            used = expected = start
            for n, freed in batches:
                expected = retention._taken(expected, n, freed, cap)[0]
            for sub in sorted({r[0] for r in rows}):
                mine = [r for r in rows if r[0] == sub]
                if mine[0][3] < 0:
                    used = retention._taken(used, mine[0][1], mine[0][2], cap)[0]
                else:
                    _, lo, out, slope = max(r for r in mine if r[1] <= used)
                    used = out + slope * (used - lo)
            assert used == expected


def test_seals_are_counted_alike_in_parts(spark):
    rng = random.Random(4)
    rows = [("b", "s", f"boot{rng.randrange(2)}", "r", pos, rng.randrange(100)) for pos in range(60)]
    discards = spark.createDataFrame([r for r in rows if r[5] % 4], "buffer_id string, sensor_id string, boot_id string, reason string, pos long, mono_ns long")
    seals = spark.createDataFrame([r[:5] for r in rows if r[5] % 4 == 0], "buffer_id string, sensor_id string, boot_id string, reason string, pos long")
    found = [sorted(map(tuple, retention.seal_epochs(discards, seals, part_rows).collect())) for part_rows in (7, 1000)]
    assert found[0] == found[1] and len(found[0]) > 4


@pytest.mark.parametrize("part_moves", [4, 100_000])
def test_states_of_long_histories(spark, part_moves):
    """Against a loop, with ties in pos, unknown and missing states, and histories over many parts."""
    rng = random.Random(part_moves)
    moves = [("b", None if i == 3 else i, rng.choice([None, *range(40)]), rng.choice([0, 0, 1, 1, 1, None, 7, *([2, 3] if k > i else [])])) for i in range(40) for k in range(rng.randint(1, 50))]
    expected, allowed = {}, {0: (1,), 1: (0, 2, 3)}
    first = lambda x: (x is not None, x or 0)
    for b, i, _, to in sorted(moves, key=lambda m: (first(m[1]), first(m[2]), first(m[3]))):
        now = expected.setdefault((b, i), 0)
        expected[b, i] = to if to in allowed.get(now, ()) else now
    found = delivery.states(spark.createDataFrame(moves, "buffer_id string, id long, pos long, to_state int").repartition(3), part_moves)
    assert {(r["buffer_id"], r["id"]): r["state"] for r in found.collect()} == expected
    assert set(expected.values()) == {0, 1, 2, 3} and "collect_list" not in found._jdf.queryExecution().toString()
