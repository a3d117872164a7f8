"""Centroid clustering of vectors on integers, over distinct vectors with their multiplicities.

Vectors are quantised to integers; equal ones are one from there on, with their number as a weight. Each of Lloyd's rounds
reads the distinct vectors: tasks assign theirs to the nearest centroid and add them up by cluster, weighted, and only
those sums (clusters times components) are shuffled and come to the driver, which divides them. At the end the assignments
are joined back to the ids by a digest of the vector. All sums and distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import beside_counted, materialize

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Largest integer component whose squared distances are exact in doubles: 4 * 64 * 2 ** 44 = 2 ** 52.
EXACT = 1 << 22
#: Rows of distinct vectors that are compared at once.
BLOCK = 16_384
LONG_MAX = (1 << 63) - 1


def quantised(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the integers floor(scale * x), of every vector that has so many components, none of them null, NaN or
    infinite. Rows without a vec_id are left out. Integers are kept within the range of a long."""
    v = F.col("v")
    sound = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL").where(sound)
    whole = lambda x: F.floor(F.least(F.greatest(scale * x, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long")
    return kept.select("vec_id", F.transform(v, whole).alias("q"))


def digest(q: str) -> Column:
    """The sha256 of integers in decimal, joined by commas."""
    return F.sha2(F.array_join(F.col(q).cast("array<string>"), ","), 256)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smallest of several), and the squared distance. Both are int64 or,
    for large components, Python's integers."""
    if x.dtype == object or centroids.dtype == object:
        distance = ((x.astype(object)[:, None, :] - centroids.astype(object)[None]) ** 2).sum(2)
    else:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        distance = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    at = distance.argmin(1)
    least = distance[np.arange(len(x)), at]
    return at, least if least.dtype == object else least.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x if not x.size or max(int(x.max()), -int(x.min())) <= EXACT else x.astype(object)


def _integers(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(x) > EXACT for row in rows for x in row)
    return np.array(rows, object if large else np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """cluster, n, and the sums of its vectors' components (in decimal, as they may be large), one row for each cluster and
    task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width), object)
        number = np.zeros(len(centroids), object)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x, weight = _matrix(part.column("q"), width), part.column("weight").to_numpy()
                cluster, _ = nearest(x, centroids)
                small = x.dtype != object and len(x) * int(weight.max()) < 1 << 40
                x, weight = (x, weight) if small else (x.astype(object), weight.astype(object))
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    total[c] += (x[mine] * weight[mine][:, None]).sum(0).astype(object)
                    number[c] += int(weight[mine].sum())
        for c in np.flatnonzero(number).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int(number[c])], pa.int64()), pa.array([[str(s) for s in total[c]]], pa.list_(pa.string()))], ["cluster", "n", "total"])

    return distinct.select("q", "weight").mapInArrow(add, "cluster int, n long, total array<string>")


def _moved(distinct: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round: of each cluster the floor of its mean; empty ones stay."""
    sums = _sums(distinct, _integers(centroids), width)
    by_part = sums.select("cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for row in by_part.collect():  # clusters times components
        out[row["cluster"]][row["at"]] = int(row["s"]) // row["n"]
    return out


def _assigned(distinct: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    held = _integers(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                cluster, distance = nearest(_matrix(part.column("q"), width), held)
                fits = pa.array([int(d) if d <= LONG_MAX else None for d in distance] if distance.dtype == object else distance, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("weight"), pa.array(cluster, pa.int32()), fits], ["key", "weight", "cluster", "distance"])

    return distinct.select("key", "q", "weight").mapInArrow(assign, "key string, weight long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, seeds: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, salt: str = "2:") -> DataFrame:
    """For every sound vector (see quantised): vec_id, cluster, distance (squared, to its centroid), cluster_inertia and
    inertia (distances added up over its cluster and over all), and centroid, its final centroid's components.

    The first centroids are the vectors whose sha256 of salt and vec_id (decimal) is smallest, in that order; fewer if there
    are fewer vectors. Of equal distances the smaller number wins. Rows of one vec_id are vectors of their own (of equal
    hashes the smaller vector is the earlier seed). A distance or sum beyond a long is null. Other columns are not looked
    at. An empty table gives no rows."""
    q = quantised(vectors, components, scale)
    distinct = materialize(q.groupBy("q").agg(F.count(F.lit(1)).alias("weight")).select(digest("q").alias("key"), "q", "weight"))
    first = q.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "q").select("q").limit(seeds).collect()
    centroids = [list(r["q"]) for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(distinct, centroids, components)
    of_vector = materialize(_assigned(distinct, centroids, components))
    # one row for each cluster: no more than there are seeds
    part = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("weight"))
    sums = {r["cluster"]: r["s"] for r in of_vector.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), part).alias("s")).collect()}
    fits = lambda s: int(s) if s is not None and s <= LONG_MAX else None
    whole = fits(sum(sums.values())) if None not in sums.values() else None
    totals = [(c, fits(s), whole, centroids[c]) for c, s in sums.items()]
    named = vectors.sparkSession.createDataFrame(totals, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    placed = beside_counted(q.select("vec_id", digest("q").alias("key")), of_vector, ["key"], "weight", F.col("vec_id"))
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
