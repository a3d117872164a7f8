"""Queries of the training-data operators against their SQL in DuckDB, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from fieldtally.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def test_awkward_texts(spark, tmp_path):
    """Nulls, empty and equal texts, texts of fewer words than a shingle, and repeats within a text."""
    texts = [None, "", " \t", "one", "one", "Two words", "two  WORDS", "a b c d e", "a b c d e f", "é" * 120, "é" * 121, "x" * 99, "x" * 100, "x" * 300, "日本語 " * 60]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name in ("op8_suffix_dedup", "op10_jaccard_join"):
        found = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(found.fetchall())
