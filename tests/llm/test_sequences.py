"""Periodic runs, byte-pair encoding and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest

from fieldtally.llm import bytepairs, centroids, periodic, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BLANK = "[\x20\x09-\x0d]+"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def plain_runs(words, least=24, exponent=3):
    """By every period: stretches of places equal to the one a period behind, of periods that are the smallest."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - start + q >= max(least, exponent * q):
                    found.setdefault((start, i - start + q), q)
                start = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_runs(rng):
    out = []
    for k in range(150):
        words = [rng.choice("abcdefgh"[: 1 + k % 8]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            whole = unit * rng.randint(2, 7)
            at = rng.randint(0, len(words))
            words[at:at] = whole[: rng.randint(1, len(whole))]
        out.append(words)
    return out


def test_runs_equal_a_plain_version():
    rng = random.Random(5)
    for least, exponent in ((24, 3), (6, 2), (2, 2), (10, 4)):
        k = periodic.factor_length(least, exponent)
        for words in texts_with_runs(rng):
            words = [w.encode() for w in words]
            assert periodic.text_runs(words, least, exponent, k) == plain_runs(words, least, exponent), words


def test_every_long_periodic_text_is_one_run():
    for q in (1, 2, 500, 3333):
        words = [f"w{i % q}".encode() for i in range(10_000)]
        assert periodic.text_runs(words, 24, 3, 9) == [(0, 10_000, q)]


def op11_row(doc_id, text):
    words = [w for w in re.split(BLANK, text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def awkward(rng):
    texts = [" ".join(w) for w in texts_with_runs(rng)] + [None, "", " \t\n", "x", "x " * 23, "x\x0b" * 24, "é a " * 40, "ab " * 5000, "x y\x1cz " * 30, "x y\xa0z " * 30]
    return [*enumerate(texts), (3, texts[3]), (3, "other " * 30)]


def test_periodic_query(spark, tmp_path):
    rows = awkward(random.Random(9))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS _n", "'x' AS collapsed", "3 AS start")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {c for _, c in found.dtypes[:6]} == {"bigint"}
    expected = [op11_row(*r) for r in rows]
    assert sum(r[1] > 0 for r in expected) > 20 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0
    no_id = periodic.periodic_runs(spark.createDataFrame([(None, "a b " * 20)], "doc_id long, text string")).first()
    assert (no_id["doc_id"], [tuple(r) for r in no_id["runs"]], no_id["collapsed"]) == (None, [(0, 40, 2)], "a b")


@pytest.fixture(scope="module")
def plain_encoding():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(RANKS), special_tokens={})


def byte_pair_texts():
    rng = random.Random(3)
    points = "".join(chr(c) for c in range(0, 0x110000) if not 0xD800 <= c < 0xE000)
    texts = [None, "", " ", "a" * 5000, "ab" * 3000, "é" * 127, "é" * 128, "x" * 255, "x" * 256, "x" * 257, "it's WE'LL 'S  \t\n x  ", "<|endoftext|>", "\x1c\x1d\x85  a b", "日本語テキスト" * 90, points, points[::7]]
    for _ in range(200):
        texts.append("".join(rng.choice("aeinrst hlo'1é日\n") for _ in range(rng.randint(1, 900))).replace(" ", rng.choice(["", " ", "  "])))
    return texts


def test_byte_pairs_equal_the_library(spark, tmp_path, plain_encoding):
    texts = byte_pair_texts()
    rows = [*enumerate(texts), (4, texts[4]), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS data")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_byte_pairs(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    expected = []
    for i, text in rows:
        ids = plain_encoding.encode_ordinary(text or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    apart = bytepairs.decode_ids(bytepairs.encode_texts(frame.where("doc_id < 12"), RANKS, public_tokenizers.PATTERN), RANKS)
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in apart.collect()} == {i: t or "" for i, t in enumerate(texts[:12])}
    assert bytepairs.encode_texts(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_alike(plain_encoding):
    """The heap for long words, and matrices of any width, give what the library gives."""
    pairs = bytepairs.loaded(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(150):
        word = "".join(rng.choice("aeinrstéo") for _ in range(rng.randint(2, 250)))
        expected = np.array(plain_encoding.encode_ordinary(word), "<u4").tobytes()
        data = word.encode()
        whole = pairs.ids.get(data)
        if whole is None:
            assert pairs.merge_long(data) == expected and pairs.merge([data], len(data) + rng.randint(0, 9)) == [expected]
    long = "".join(rng.choice("abé1 ") for _ in range(bytepairs.STEP))
    assert list(pairs.encode([long])) == [np.array(plain_encoding.encode_ordinary(long), "<u4").tobytes()]


def plain_clusters(rows, seeds=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centers = [q for _, _, q in sorted((sha(f"2:{i}"), q, q) for i, q in kept)[:seeds]]
    near = lambda q: min((sum((x - c) ** 2 for x, c in zip(q, m, strict=True)), k) for k, m in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centers = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else m for k, m in enumerate(centers)]
    out = [(i, *near(q)) for i, q in kept]
    return sorted((i, k, d, sum(e for _, e, c in out if c == k), sum(e for _, e, _ in out), sha(",".join(map(str, centers[k])))) for i, d, k in out)


def vectors(rng, scale=1.0):
    base = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(70)]
    rows = [(i, base[rng.randrange(len(base)) if i % 3 else 0]) for i in range(300)]
    rows += [(300, None), (301, []), (302, base[0][:63]), (303, base[1] + [0.0]), (304, [None, *base[2][1:]]), (305, [float("nan"), *base[2][1:]]), (306, [float("-inf"), *base[2][1:]]), (307, [0.0] * 64), (308, [-0.0] * 64)]
    return [*rows, (5, base[5]), (5, base[6]), (5, base[6]), (None, base[7])]


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_clusters_equal_a_plain_version(spark, tmp_path, scale):
    rows = vectors(random.Random(6), scale)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS weight", "3 AS cluster")
    frame.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op13_centroids(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, found.collect())) == plain_clusters(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(queries.CENTROIDS_SQL).fetchall()) == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(empty).collect() == []
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (3, [1e30] * 64)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in centroids.cluster_vectors(few).collect()}
    assert {r["distance"] for r in found.values()} == {0} and len({r["cluster"] for r in found.values()}) == 3
    one = {r["vec_id"]: r for r in centroids.cluster_vectors(few, seeds=1).collect()}
    assert one[1]["distance"] is None and one[1]["inertia"] is None


def test_ties_go_to_the_smaller_number():
    x, c = np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [6, 0]])
    for kind in (np.int64, object):
        at, distance = centroids.nearest(x.astype(kind), c.astype(kind))
        assert at.tolist() == [0, 0] and distance.tolist() == [4, 4]
