"""Lloyd's k-means on DataFrames.

Points go to the nearest centroid by squared L2, ties to the lowest cluster number. A centroid becomes the mean of
its points, summed in double and narrowed to float32; an empty cluster keeps its centroid. Iteration stops after
the round in which no assignment changed, or after max_iter rounds; the assignments returned are those of the last
round, made before its update. Only the k centroids visit the driver between rounds, never points or assignments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import Metric, l2_squared, score_matrix

CENTROIDS = "cluster_id int, centroid array<float>"


def seed_centroids(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k distinct rows in a random order that depends on the seed and the id only; fewer if there are fewer."""
    picked = vectors.select("id", "vector").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(k).collect()
    return centroid_frame(vectors, [r.vector for r in picked])


def centroid_frame(like: DataFrame, centroids: list) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return like.sparkSession.createDataFrame(rows, CENTROIDS)


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster_id, distance) by Column expressions; the k centroids are broadcast."""
    pairs = vectors.crossJoin(F.broadcast(centroids)).select("id", "cluster_id", l2_squared(F.col("vector"), F.col("centroid")).alias("d"))
    best = pairs.groupBy("id").agg(F.min(F.struct("d", "cluster_id")).alias("best"))
    return best.select("id", F.col("best.cluster_id").alias("cluster_id"), F.col("best.d").alias("distance"))


def assign_blocks(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with cluster_id, by the numpy kernel: one pass without a shuffle; the same bits as assign()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = piece.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                near = score_matrix(Metric.L2, x, centroids).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(near)], [*piece.schema.names, "cluster_id"])

    return vectors.select("id", "vector").mapInArrow(run, "id string, vector array<float>, cluster_id int")


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, centroid, n): the mean of the members in the order of their ids, or the old centroid if there are none."""
    terms = assigned.select("cluster_id", "id", F.posexplode("vector").alias("j", "x"))
    ordered = F.array_sort(F.collect_list(F.struct("id", F.col("x").cast("double").alias("x"))))
    means = terms.groupBy("cluster_id", "j").agg(ordered.alias("xs")).select("cluster_id", "j", (F.aggregate("xs", F.lit(0.0), lambda s, e: s + e["x"]) / F.size("xs")).cast("float").alias("m"), F.size("xs").cast("bigint").alias("n"))
    means = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda e: e["m"]).alias("mean"), F.max("n").alias("n"))
    return centroids.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "centroid").alias("centroid"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def partial_sums(assigned: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the clusters: each task sums its own points, k * dim numbers for each leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at = batch.column("cluster_id").to_numpy()
            np.add.at(sums, at, x.astype(np.float64))
            counts += np.bincount(at, minlength=k)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.float64()))], ["cluster_id", "n", "s"])

    parts = assigned.select("vector", "cluster_id").mapInArrow(run, "cluster_id int, n bigint, s array<double>")
    each = parts.select("cluster_id", "n", F.posexplode("s").alias("j", "x")).groupBy("cluster_id", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = each.groupBy("cluster_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "x"))).alias("s")).collect()
    sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
    for r in rows:
        sums[r.cluster_id], counts[r.cluster_id] = [e.x for e in r.s], r.n
    return sums, counts


def default_k(n: int) -> int:
    return max(1, math.isqrt(max(0, n)))


def kmeans(vectors: DataFrame, centroids: DataFrame, max_iter: int = 25) -> tuple[DataFrame, DataFrame]:
    """(centroids, assigned vectors) from given seed centroids.

    Convergence is seen without keeping assignments: equal centroids after two updates give equal assignments in
    the round that follows, which is the round after which the loop stops.
    """
    now = np.array([r.centroid for r in centroids.orderBy("cluster_id").collect()], dtype=np.float32)
    if max_iter < 1 or not len(now):
        return centroids, vectors.select("id", "vector", F.lit(0).alias("cluster_id"))
    used = now
    for _ in range(max_iter):
        used = now
        sums, counts = partial_sums(assign_blocks(vectors, now), len(now), now.shape[1])
        now = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now).astype(np.float32)
        if np.array_equal(now, used):
            break
    return centroid_frame(vectors, now.tolist()), assign_blocks(vectors, used)


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether any assignment differs."""
    both = before.select("id", F.col("cluster_id").alias("was")).join(after.select("id", F.col("cluster_id").alias("now")), "id")
    return both.agg(F.coalesce(F.bool_or(F.col("was") != F.col("now")), F.lit(False)).alias("changed"))


def kmeans_fast(vectors: DataFrame, k: int, max_iter: int = 25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The library's k-means, all in the JVM: stops when centres move little, so results differ from kmeans()."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, initMode="random", predictionCol="cluster_id").fit(rows)
    return centroid_frame(vectors, [c.tolist() for c in model.clusterCenters()]), model.transform(rows).select("id", "vector", "cluster_id")
