"""One query for each operator, over its whole tables, and the pipeline; SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.quality import score_quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.pii import span_report

    return span_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.language import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.chunks import chunk_report

    return chunk_report(table(spark, sf_dir, "documents")).select("doc_id", "n_chunks", "n_bytes", "n_spans", "first_docs")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def periodic_text() -> Column:
    """The text of op11: where crc32(doc_id) % 10 = 0, the words from place g % n on repeat those of one period."""
    n, g, a, p = (F.col(c) for c in ("_n", "_g", "_a", "_p"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.floor((n - a) / p).cast("int") + 1)), 1, n - a)
    return F.when(n > 0, F.array_join(F.concat(F.slice("_words", 1, a), tail), " ")).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.periodic import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("_words"))
    docs = docs.select("*", F.size("_words").alias("_n"))
    docs = docs.select("*", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int").alias("_a"))
    docs = docs.select("*", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int").alias("_p"))
    found = periodic_runs(docs.select("doc_id", periodic_text().alias("text")))
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.bytepairs import encode_texts

    done = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtally.llm.centroids import cluster_vectors, digest

    return cluster_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest("centroid").alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_personal_data": op2_personal_data,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}

#: Links by joining the classes of equal sets on their shingles, components by reaching along links.
JACCARD_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
c AS (SELECT shingles, min(doc_id) AS id, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT id, unnest(shingles) AS h FROM c),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM pairs JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS r FROM c UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, CAST(coalesce(least.component_id, s.doc_id) AS BIGINT) AS component_id FROM s LEFT JOIN c ON c.shingles = s.shingles LEFT JOIN least ON least.id = c.id"""

#: Every window of 100 bytes by its digest; those that also start earlier cover bytes, and runs of them are islands.
REPEATS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(hx, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, hx, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
cut AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM cut GROUP BY doc_id, k),
piece AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS came FROM span),
left_over AS (SELECT doc_id, string_agg(substr(hx, 2 * came + 1, 2 * (a - came)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS hx, sum(b - a) AS gone, count(*) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(l.hx, d.hx))) AS kept_sha256 FROM d LEFT JOIN left_over l USING (doc_id)"""

#: Lloyd's rounds on single components; the first centroids by the hash of their id.
CENTROIDS_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS r, vec_id, q FROM v),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS c FROM n),
s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q FROM n QUALIFY k < 40),
c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(q) AS m FROM s),
""" + ",\n".join(
    f"d{t} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((c - m) * (c - m)) AS d FROM x JOIN c{t} USING (i) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"
    + (f",\nc{t + 1} AS MATERIALIZED (SELECT k, i, coalesce(CAST(g.m AS HUGEINT), c{t}.m) AS m FROM c{t} LEFT JOIN (SELECT k, i, CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS m FROM (SELECT k, i, sum(c) AS s, count(*) AS n FROM x JOIN d{t} USING (r) GROUP BY k, i)) g USING (k, i))" if t < 5 else "")
    for t in range(6)
) + """
SELECT n.vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM d5 JOIN n USING (r) JOIN (SELECT k, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c5 GROUP BY k) USING (k)"""

ORACLES: dict[str, str] = {"op13_centroids": CENTROIDS_SQL, "op8_suffix_dedup": REPEATS_SQL, "op10_jaccard_join": JACCARD_SQL}
