"""The pipeline against the operators' own rules, stage by stage."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from fieldtally.llm import pii
from fieldtally.llm.common import materialize


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "ou", "th", "ing"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    rows = {i: prose(120) for i in range(30)}
    rows[40] = rows[3]
    rows[41] = rows[4] + " more"
    rows[42] = prose(60) + " " + item + " " + prose(60)
    rows[43] = prose(60) + " jo@mail.example.com " + prose(60)
    rows[44] = " | ".join(word() + "###" for _ in range(90))
    rows[45] = "too short"
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(46, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, corpus))
        assert docs.columns == columns
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = set(range(30)) | {40, 41, 42, 43}
    assert set(after["quality rules"]) == base
    assert set(after["n-gram Jaccard join"]) == base - {40, 41}
    assert set(after["benchmark decontamination"]) == base - {40, 41, 42}
    assert set(after["PII"]) == base - {40, 41, 42} and "[EMAIL]" in after["PII"][43]
    assert all(not pii.base_spans(t) for t in after["PII"].values())
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert {r["doc_id"] for r in packed} == set(after["PII"])


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
