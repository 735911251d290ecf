"""The inverted-file index: vectors in Parquet partitioned by cluster, read only where a query probes
(M2-M4, K5, S4, S5, J3, J7, T2, T3, P7).

A search ranks the centroids for all its queries, takes the union of the clusters they probe, and puts that list
into the scan as a literal, which is what makes Spark skip the other partitions; the probe list is then joined
again, so that each query sees its own clusters only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import Metric, l2_squared, score_matrix
from ..operators import kmeans as km
from ..operators.knn import rank
from ..operators.replay import max_seq, snapshot
from ..schema import check_k
from ..sources.store import Store, sequence_name
from . import catalog

#: Rows of a cluster file; larger clusters are written as several files.
ROWS_PER_FILE = 1_000_000


class Index:
    """An opened index: centroids on the driver (k rows), clusters as a lazy table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        head = json.loads(spark.read.text(f"{self.folder}/head", wholetext=True).first().value)
        self.seq, self.k, self.dim = head["seq"], head["k"], head["dim"]
        rows = spark.read.parquet(f"{self.folder}/centroids").orderBy("cluster_id").collect()
        self.centroids = np.array([r.centroid for r in rows], dtype=np.float32).reshape(len(rows), self.dim)
        if len(rows) != self.k:
            raise ValueError(f"{self.folder}: {len(rows)} centroids, {self.k} in the head")

    @property
    def clusters(self) -> DataFrame:
        return self.spark.read.schema("id string, vector array<float>, cluster_id int").parquet(f"{self.folder}/clusters")

    def probes(self, queries: DataFrame, nprobe: int) -> tuple[DataFrame, list[int]]:
        """(query_id, vector, cluster_id) of the clusters each query looks into, and the union of the clusters."""
        n = max(1, min(nprobe, self.k))
        ranked = centroid_ranks(queries, km.centroid_frame(queries, self.centroids.tolist()))
        chosen = ranked.filter(F.col("rank") <= n)
        union = sorted(r.cluster_id for r in chosen.select("cluster_id").distinct().collect())  # at most k
        return queries.join(chosen.select("query_id", "cluster_id"), "query_id"), union

    def search(self, queries: DataFrame, k: int, nprobe: int = 10, skip: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, score) over the probed clusters, without the ids in `skip`."""
        probes, union = self.probes(queries, nprobe)
        return search_probed(self.clusters.filter(F.col("cluster_id").isin(union)), probes, k, skip)

    def search_one(self, vector: list[float], k: int, nprobe: int = 10, skip: DataFrame | None = None) -> DataFrame:
        """(id, score) for one query: the clusters are ranked on the driver, and the scan has their literal list."""
        if len(vector) != self.dim:
            raise ValueError(f"the query has {len(vector)} numbers; {self.dim} are needed")
        d = score_matrix(Metric.L2, np.array([vector]), self.centroids)[0]
        near = np.lexsort((np.arange(self.k), d))[: max(1, min(nprobe, self.k))].tolist()
        rows = self.clusters.filter(F.col("cluster_id").isin(near))
        if skip is not None:
            rows = rows.join(skip.select("id").distinct(), "id", "left_anti")
        query = F.array(*[F.lit(float(x)).cast("float") for x in vector])
        return rows.select("id", l2_squared(F.col("vector"), query).alias("score")).orderBy("score", "id").limit(check_k(k))


def search_probed(members: DataFrame, probes: DataFrame, k: int, skip: DataFrame | None = None) -> DataFrame:
    """The k nearest of each query among the members (id, vector, cluster_id) of the clusters it probes."""
    if skip is not None:  # before the distances, which then need not be computed
        members = members.join(skip.select("id").distinct(), "id", "left_anti")
    pairs = members.join(probes.select("query_id", F.col("vector").alias("query"), "cluster_id"), "cluster_id")
    scored = pairs.select("query_id", "id", l2_squared(F.col("vector"), F.col("query")).alias("score"))
    return rank(scored, k).select("query_id", "rank", "id", "score")


def centroid_ranks(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, cluster_id, distance, rank) of every centroid for every query, nearest first, ties to the lower."""
    pairs = queries.crossJoin(F.broadcast(centroids))
    scored = pairs.select("query_id", F.col("cluster_id"), l2_squared(F.col("vector"), F.col("centroid")).alias("distance"))
    order = F.array_sort(F.collect_list(F.struct("distance", "cluster_id")))  # k entries for a query
    ranked = scored.groupBy("query_id").agg(order.alias("ranked")).select("query_id", F.posexplode("ranked").alias("at", "e"))
    return ranked.select("query_id", "e.cluster_id", "e.distance", (F.col("at") + 1).alias("rank"))


def write(assigned: DataFrame, centroids: DataFrame, folder: str, seq: int, dim: int) -> None:
    """Clusters first, head last: a folder without a head is not an index."""
    spark = assigned.sparkSession
    k = centroids.count()
    # A cluster is one task's work up to ROWS_PER_FILE rows; a larger one is dealt over several by a hash of the id.
    shares = km.sizes(assigned).select("cluster_id", F.ceil(F.col("n") / ROWS_PER_FILE).alias("shares"))  # k rows
    dealt = assigned.select("id", "vector", "cluster_id").join(F.broadcast(shares), "cluster_id").withColumn("share", F.pmod(F.xxhash64("id"), "shares"))
    dealt = dealt.repartition("cluster_id", "share").sortWithinPartitions("cluster_id", "id").select("id", "vector", "cluster_id")
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("cluster_id").parquet(f"{folder}/clusters")
    centroids.select("cluster_id", "centroid").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/centroids")
    head = spark.createDataFrame([(json.dumps({"seq": seq, "k": k, "dim": dim}),)], "value string")
    head.coalesce(1).write.mode("errorifexists").text(f"{folder}/head")


def offsets(lengths: DataFrame) -> DataFrame:
    """Running start of each cluster's block (K6) from (cluster_id, length): k rows."""
    from pyspark.sql import Window

    run = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("cluster_id", F.coalesce(F.sum("length").over(run), F.lit(0).cast("bigint")).alias("start"))


def build_index(spark: SparkSession, store: Store, log: DataFrame, k: int | None = None, max_iter: int = 25, seed: int = 0) -> tuple[str, catalog.Manifest | None]:
    """Replay the log, cluster, write, publish; ("published", manifest), or ("conflict", None) if another build won.

    k: None or 0 for the square root of the number of vectors. The dimension is that of the first id in byte order;
    any other length is an error, as is a log without a live vector.
    """
    try:
        base = catalog.latest(store).version
    except catalog.NoManifestError:
        base = 0
    live = snapshot(log)
    facts = live.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", F.size("vector").alias("dim"))).alias("first"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if not facts.n:
        raise ValueError("the log has no live vector to index")
    dim = facts["first"]["dim"]
    if not facts.low == facts.high == dim:
        raise ValueError(f"vectors of {facts.low} to {facts.high} numbers; the first id has {dim}")
    seq = max_seq(log).first().max_seq
    k = min(k or km.default_k(facts.n), facts.n)
    centroids, assigned = km.kmeans(live, km.seed_centroids(live, max(1, k), seed), max_iter)
    name = catalog.build_folder(seq)
    write(assigned, centroids, store.path(f"index/{name}"), seq, dim)
    manifest = catalog.Manifest(base + 1, name, seq, dim, centroids.count())
    try:
        catalog.publish(store, manifest)
    except catalog.ConflictError:
        return "conflict", None
    return "published", manifest


def open_latest(spark: SparkSession, store: Store) -> Index:
    """The published index; its head must agree with the manifest."""
    manifest = catalog.latest(store)
    index = Index(spark, store.path(f"index/{manifest.index}"))
    if (index.seq, index.k, index.dim) != (manifest.index_seq, manifest.k, manifest.dim):
        raise ValueError("the manifest and the index disagree")
    return index


def log_name(seq: int) -> str:
    return sequence_name("wal", seq, ".bin")
