"""Registered queries that write with the engine's own sinks and read back with its sources, and their SQL oracles.

Each run writes below a new folder of the session's shared folder: spark.checkpoint.dir, or the warehouse where that is
unset. What is written is made of the same tables as in `catalogue`, always of all their rows.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .operators import kmeans as km
from .operators import knn
from .plans import catalog, ivf, search
from .schema import MANIFEST
from .service import Engine
from .sources import binindex, binlog, register, vecfiles
from .sources.store import Store, json_requests
from .streaming import ingest


def work(spark: SparkSession) -> Store:
    register(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Store(spark, f"{folder}/quiverlake-{uuid.uuid4().hex}")


def _local(store: Store) -> str:
    """The local path of a store, for formats that are local by nature."""
    return store.base.removeprefix("file://").removeprefix("file:")


def _written_log(spark: SparkSession, sf: str) -> Store:
    store = work(spark)
    binlog.write_oplog(base.oplog(spark, sf), f"{_local(store)}/wal")
    return store


def _format(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.format("oplog").load(f"{_local(_written_log(spark, sf))}/wal")


def _after(spark: SparkSession, sf: str) -> DataFrame:
    return binlog.read_oplog(spark, _written_log(spark, sf).path("wal"), base.AFTER)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _written_log(spark, sf).files("wal").select(F.regexp_extract("path", r"(wal/[^/]*)$", 1).alias("path"), "length")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON requests in one file, in order of their ids; the log that the stream makes of them, and one file before."""
    store = work(spark)
    events = spark.read.parquet(f"{sf}/events.parquet")
    found = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("v"), "embedding")
    upsert = F.col("event_type") != "error"
    requests = events.select("event_id", F.when(upsert, "upsert").otherwise("delete").alias("op"), F.col("user_id").cast("string").alias("id"), F.when(upsert, F.col("event_id") % 500).alias("v"))
    requests = requests.join(found, "v", "left").select("event_id", "op", "id", F.col("embedding").alias("vector"))
    requests.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(store.path("requests"))
    ingest.Writer(store, base.DIM).write([(0, "before", [1.0] * base.DIM)])
    ingest.start(spark, store.path("requests"), store, store.path("checkpoint"), base.DIM).awaitTermination()
    return binlog.read_oplog(spark, store.path("wal"))


def _written_index(spark: SparkSession, sf: str) -> Store:
    """The catalogue's clustering, written as an index and published."""
    store = work(spark)
    members, centroids = base._index(spark, sf)
    ivf.write(members, centroids, store.path("index/one"), 7, base.DIM)
    catalog.publish(store, catalog.Manifest(1, "one", 7, base.DIM, centroids.count()))
    return store


def _searched(nprobe: int) -> base.Query:
    return lambda spark, sf: ivf.open_latest(spark, _written_index(spark, sf)).search(base.query_set(spark, sf), 10, nprobe)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.open_latest(spark, _written_index(spark, sf)).clusters.select("id", "vector", "cluster_id")


def _built(spark: SparkSession, sf: str) -> DataFrame:
    """An index built from the written log by k-means to the end, searched in all its clusters with no newer writes."""
    store = _written_log(spark, sf)
    log = binlog.read_oplog(spark, store.path("wal"))
    ivf.build_index(spark, store, log)
    index = ivf.open_latest(spark, store)
    return search.hybrid(base.query_set(spark, sf), 10, log, index, index.k)


def _served(spark: SparkSession, sf: str) -> DataFrame:
    """The service's answer to vec_id 0 over the written log without an index, after one write and one delete."""
    engine = Engine(spark, _written_log(spark, sf).base, base.DIM)
    engine.query({"vector": [0.0] * base.DIM, "k": 1})
    engine.write({"id": "new", "vector": base.one_query(spark, sf)})
    engine.delete({"id": "7"})
    found = engine.query({"vector": base.one_query(spark, sf), "k": 10})["results"]
    return spark.createDataFrame([(r["id"], r["score"]) for r in found], "id string, score float")


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the binary index files, read cluster by cluster as ranges; k clusters of k members or so."""
    store = work(spark)
    members, centroids = base._index(spark, sf)
    middle = np.array([r.centroid for r in centroids.orderBy("cluster_id").collect()], dtype=np.float32)
    clusters: list[list[binindex.Member]] = [[] for _ in middle]
    for r in members.orderBy(F.col("id").cast("bigint")).toLocalIterator():
        clusters[r.cluster_id].append((r.id, np.array(r.vector, np.float32)))
    binindex.write_index(store, "binary", 7, middle, clusters)
    index = binindex.BinaryIndex(store, "binary")
    rows = [(c, name, vector.tolist()) for c in range(index.k) for name, vector in index.cluster(c)]
    return spark.createDataFrame(rows, "cluster_id int, id string, vector array<float>")


def _versions(spark: SparkSession, sf: str) -> Store:
    """Every nation tries to publish the version of its region, in order; all but the first of each lose."""
    store = work(spark)
    for r in spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").toLocalIterator():
        try:
            catalog.publish(store, catalog.Manifest(r.n_regionkey + 1, r.n_name, r.n_nationkey, base.DIM, 1))
        except catalog.ConflictError:
            pass
    return store


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.history(spark, _versions(spark, sf)).select("version", "index", "index_seq", "dim", "k")


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.latest(_versions(spark, sf))
    return spark.createDataFrame([(found.version, found.index, found.index_seq, found.dim, found.k)], MANIFEST)


def _race(spark: SparkSession, sf: str) -> DataFrame:
    """All nations of a region publish its version at once: how many won and lost."""
    store = work(spark)
    rows = spark.read.parquet(f"{sf}/nation.parquet").collect()  # 25 rows

    def attempt(r) -> tuple[int, bool]:
        try:
            catalog.publish(store, catalog.Manifest(r.n_regionkey + 1, r.n_name, r.n_nationkey, base.DIM, 1))
        except catalog.ConflictError:
            return r.n_regionkey + 1, False
        return r.n_regionkey + 1, True

    with ThreadPoolExecutor(len(rows) or 1) as pool:
        outcome = spark.createDataFrame(list(pool.map(attempt, rows)), "version bigint, won boolean")
    return outcome.groupBy("version").agg(F.count_if("won").alias("winners"), F.count_if(~F.col("won")).alias("losers"))


def _vecs(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_local(work(spark))}.fvecs"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("embedding").toArrow()
    vecfiles.write_vecs(path, rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, base.DIM))
    return spark.read.format("vecs").option("split", 40_000).load(path)


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of each query written as an integer file and read back."""
    path = f"{_local(work(spark))}.ivecs"
    found = knn.block_top_k(base.vectors(spark, sf), base.query_set(spark, sf), 10)
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("int").alias("id")))).alias("best")).orderBy("query_id")
    vecfiles.write_vecs(path, np.array([[x.id for x in r.best] for r in rows.collect()], dtype=np.int32))  # one row a query of the file
    return spark.read.format("vecs").option("element", "int").load(path)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    store = work(spark)
    base.vectors(spark, sf).withColumn("k", F.lit(10)).write.json(store.path("requests"))
    return json_requests(spark, store.path("requests"))


def _blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's name as a file: the list, whole contents and a range of each."""
    store = work(spark)
    for r in spark.read.parquet(f"{sf}/region.parquet").toLocalIterator():
        store.create(f"blobs/{r.r_regionkey}", r.r_name.encode())
    names = store.list("blobs/")
    return spark.createDataFrame([(n, store.read(n).decode(), store.read_at(n, 1, 3).decode()) for n in names], "name string, whole string, part string")


def _kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """The whole loop from the seeds: centroids after at most 25 rounds, by blocks and partial sums."""
    rows = base.vectors(spark, sf)
    centroids, _ = km.kmeans(rows, base.seeds(rows), 25)
    return centroids


def _rounds(n: int) -> base.Query:
    """The assignment of round n of the loop, by blocks."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = base.vectors(spark, sf)
        return km.kmeans(rows, base.seeds(rows), n)[1].select("id", "cluster_id")

    return query


_QUERIES: dict[str, base.Query] = {
    "log_round_trip": _format,
    "log_read_after": _after,
    "log_file_lengths": _files,
    "log_by_stream": _streamed,
    "index_members": _members,
    "index_search_np5": _searched(5),
    "index_built_hybrid": _built,
    "index_binary_members": _binary,
    "service_query": _served,
    "manifest_history": _history,
    "manifest_latest": _latest,
    "manifest_race": _race,
    "vecs_round_trip": _vecs,
    "vecs_truth": _truth,
    "json_requests": _requests,
    "blob_reads": _blobs,
    "kmeans_loop": _kmeans,
    "kmeans_first_blocks": _rounds(1),
}


def queries() -> dict[str, base.Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """kmeans_loop has none: SQL has no loop to convergence; tests compare it with numpy."""
    sql = base.oracle_sql()
    log = f"WITH {base._LOG}"
    before = f"SELECT 1 AS seq, 0::INT AS op_idx, 0::TINYINT AS op, 'before' AS id, list_transform(range({base.DIM}), lambda x: 1::FLOAT) AS vector"
    pairs = "(SELECT query_id, s.id, s.vector AS mv, q.vector AS qv FROM s, q)"
    length = "18 + 4 + sum(3 + strlen(id) + CASE WHEN op = 0 THEN 4 + 4 * len(vector) ELSE 0 END)"
    first = "SELECT n_regionkey, min(n_nationkey) AS n FROM nation GROUP BY 1"
    manifest = f"SELECT (n.n_regionkey + 1)::BIGINT AS version, n_name AS index, n_nationkey::BIGINT AS index_seq, {base.DIM}::INT AS dim, 1::INT AS k FROM nation n JOIN ({first}) f ON n_nationkey = f.n"
    return {
        "log_round_trip": sql["oplog_from_events"],
        "log_read_after": f"{log} SELECT * FROM l WHERE seq > {base.AFTER}",
        "log_file_lengths": f"{log} SELECT 'wal/' || lpad(seq::VARCHAR, 20, '0') || '.bin' AS path, ({length})::BIGINT AS length FROM l GROUP BY seq",
        "log_by_stream": f"{log} SELECT seq + 1 AS seq, op_idx, op, id, vector FROM l UNION ALL {before}",
        "index_members": f"WITH {base._INDEX} SELECT id, vector, cluster_id FROM a1",
        "index_search_np5": sql["ivf_search_np5"],
        "index_built_hybrid": f"{log}, {base._live('s', 'true')}, q AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0) {base._top(pairs, base._l2('mv', 'qv'))}",
        "index_binary_members": f"WITH {base._INDEX} SELECT cluster_id, id, vector FROM a1",
        "service_query": f"{log}, {base._live('s', 'true')}, o AS (SELECT embedding AS o FROM embeddings WHERE vec_id = 0), w AS (SELECT id, vector FROM s WHERE id <> '7' UNION ALL SELECT 'new', o FROM o) SELECT id, {base._l2('vector', 'o')} AS score FROM w, o ORDER BY score, id LIMIT 10",
        "manifest_history": manifest,
        "manifest_latest": f"SELECT * FROM ({manifest}) ORDER BY version DESC LIMIT 1",
        "manifest_race": "SELECT (n_regionkey + 1)::BIGINT AS version, 1::BIGINT AS winners, (count(*) - 1)::BIGINT AS losers FROM nation GROUP BY 1",
        "vecs_round_trip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding AS vector FROM embeddings",
        "vecs_truth": f"WITH t AS ({sql['knn_l2_batch']}) SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, vector FROM (SELECT query_id, list(id::INT ORDER BY rank) AS vector FROM t GROUP BY 1)",
        "json_requests": "SELECT vec_id::VARCHAR AS id, embedding AS vector, 10::INT AS k FROM embeddings",
        "blob_reads": "SELECT 'blobs/' || r_regionkey AS name, r_name AS whole, substr(r_name, 2, 3) AS part FROM region",
        "kmeans_first_blocks": f"WITH {base._ROUND1} SELECT id, cluster_id FROM a0",
    }
