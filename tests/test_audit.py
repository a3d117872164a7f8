"""Percentiles against sorted lists."""

from __future__ import annotations

import random
from statistics import median

import pytest

from fieldtally.operators import audit


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("few", [0, 1_000_000])
def test_percentiles_hold_no_group(spark, kind, few):
    rng = random.Random(8)
    of = int if kind == "long" else float
    groups = {"a": [of(rng.choice([0, 5, 10**6 + 1, -7, rng.randint(-50, 50)])) for _ in range(701)], "b": [of(3)] * 40, "c": [of(1), of(2)], None: [of(x) for x in range(10)]}
    table = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)], f"key string, v {kind}")
    found = audit.percentiles(table, "v", "key", ranges=4, few=few)
    rows = {r["key"]: tuple(r)[1:] for r in found.collect()}
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert rows[k] == (n, median(vs), vs[min(n - 1, int(n * 0.9))], vs[min(n - 1, int(n * 0.99))], vs[-1])
    assert rows["d"] == (0, None, None, None, None) and len(rows) == 5
    assert "collect_list" not in found._jdf.queryExecution().toString()
