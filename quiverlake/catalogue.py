"""The registered queries of the vector engine with their SQL oracles.

Vectors are the rows of `embeddings`; the operation log is made of all `events`: 100 events a batch, the user as
id, a delete for every error and an upsert of an embedding for the rest. Seeds of k-means are the floor(sqrt(n))
rows first by the MD5 of their id. Query sets are the rows whose id is divisible by 100, asked against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.distance import Metric, l2_squared
from .operators import kmeans as km
from .operators import knn, replay
from .plans import catalog, ivf, search
from .sources.store import sequence_of
from .streaming.ingest import group_commits

DIM, AFTER, FAR = 64, 50, 1000.0
Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def query_set(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def one_query(spark: SparkSession, sf: str) -> list[float]:
    return spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id = 0").first().embedding


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    found = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("v"), "embedding")
    delete = F.col("event_type") == "error"
    ops = group_commits(events, "event_id").select("seq", "op_idx", F.when(delete, 1).otherwise(0).cast("tinyint").alias("op"), F.col("user_id").cast("string").alias("id"), F.when(~delete, F.col("event_id") % 500).alias("v"))
    return ops.join(found, "v", "left").select("seq", "op_idx", "op", "id", F.col("embedding").alias("vector"))


def seeds(rows: DataFrame) -> DataFrame:
    k = km.default_k(rows.count())
    picked = rows.orderBy(F.md5(F.col("id").cast("binary")), "id").limit(k)  # k rows
    order = Window.orderBy(F.md5(F.col("id").cast("binary")), F.col("id"))
    return picked.select((F.row_number().over(order) - 1).cast("int").alias("cluster_id"), F.col("vector").alias("centroid"))


def _round(rows: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignment to these centroids, and the centroids after their update."""
    placed = km.assign(rows, centroids)
    return placed, km.update(rows.join(placed, "id"), centroids)


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Members by cluster, and the centroids: seeds, one update, then the assignment to the updated centroids."""
    rows = vectors(spark, sf)
    _, centroids = _round(rows, seeds(rows))
    centroids = km.centroid_frame(rows, [r.centroid for r in centroids.orderBy("cluster_id").collect()])  # k rows
    return rows.join(km.assign(rows, centroids).select("id", "cluster_id"), "id"), centroids


def _probed(spark: SparkSession, sf: str, nprobe: int | None, skip: DataFrame | None = None) -> DataFrame:
    members, centroids = _index(spark, sf)
    asked = query_set(spark, sf)
    ranks = ivf.centroid_ranks(asked, centroids)
    chosen = ranks if nprobe is None else ranks.filter(F.col("rank") <= nprobe)
    return ivf.search_probed(members, asked.join(chosen.select("query_id", "cluster_id"), "query_id"), 10, skip)


def _single(metric: Metric) -> Query:
    return lambda spark, sf: knn.top_k(vectors(spark, sf), one_query(spark, sf), 10, metric)


def _batch(metric: Metric) -> Query:
    return lambda spark, sf: knn.block_top_k(vectors(spark, sf), query_set(spark, sf), 10, metric)


def _k_exceeds_n(spark: SparkSession, sf: str) -> DataFrame:
    return knn.top_k(vectors(spark, sf), one_query(spark, sf), vectors(spark, sf).count() + 1)


def _pairwise(spark: SparkSession, sf: str) -> DataFrame:
    pairs = vectors(spark, sf).crossJoin(F.broadcast(query_set(spark, sf).select("query_id", F.col("vector").alias("q"))))
    return pairs.select("query_id", "id", l2_squared(F.col("vector"), F.col("q")).alias("score"))


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    batches = group_commits(spark.read.parquet(f"{sf}/events.parquet"), "event_id").groupBy("seq")
    return batches.agg(F.count(F.lit(1)).alias("n_ops"), F.count_if(F.col("event_type") == "error").alias("n_deletes"))


def _empty_cluster(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    first = seeds(rows)
    far = spark.createDataFrame([(km.default_k(rows.count()), [FAR] * DIM)], km.CENTROIDS)
    return _round(rows, first.unionByName(far))[1]


def _converged(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    before, centroids = _round(rows, seeds(rows))
    return km.changed(before, km.assign(rows, centroids.select("cluster_id", "centroid")))


def _two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    _, first = _round(rows, seeds(rows))
    first = km.centroid_frame(rows, [r.centroid for r in first.orderBy("cluster_id").collect()])  # k rows
    return _round(rows, first)[1].select("cluster_id", "centroid", "n")


def _seed_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return km.assign(rows, seeds(rows))


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    members, _ = _index(spark, sf)
    entry = F.lit(2) + F.octet_length("id") + F.lit(4) * F.size("vector")
    return ivf.offsets(members.groupBy("cluster_id").agg((F.sum(entry) + 4).cast("bigint").alias("length")))


def _centroid_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.centroid_ranks(query_set(spark, sf), _index(spark, sf)[1])


def _log_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log, and members and seeds of an index that covers it up to AFTER."""
    log = oplog(spark, sf)
    covered = replay.snapshot(log.filter(F.col("seq") <= AFTER), DIM)
    centroids = seeds(covered)
    centroids = km.centroid_frame(covered, [r.centroid for r in centroids.orderBy("cluster_id").collect()])  # k rows
    return log, covered.join(km.assign(covered, centroids).select("id", "cluster_id"), "id"), centroids


def _hybrid(spark: SparkSession, sf: str, nprobe: int = 3, extra: DataFrame | None = None) -> DataFrame:
    log, members, centroids = _log_index(spark, sf)
    log = log if extra is None else log.unionByName(extra)
    asked = query_set(spark, sf)
    chosen = ivf.centroid_ranks(asked, centroids).filter(F.col("rank") <= nprobe).select("query_id", "cluster_id")
    old = ivf.search_probed(members, asked.join(chosen, "query_id"), 10, replay.touched(log, DIM, AFTER))
    return search.merge([knn.block_top_k(replay.snapshot(log, DIM, AFTER), asked, 10), old], 10)


def _after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """As the hybrid search, after a delete of every user with an odd number of events."""
    users = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().filter("count % 2 = 1")
    gone = users.select(F.lit(1 << 40).cast("bigint").alias("seq"), F.lit(0).alias("op_idx"), F.lit(1).cast("tinyint").alias("op"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    return _hybrid(spark, sf, extra=gone)


def _recall(spark: SparkSession, sf: str, nprobes: tuple[int, ...]) -> DataFrame:
    """The clusters are built and ranked once, and searched for each probe count."""
    members, centroids = _index(spark, sf)
    asked = query_set(spark, sf)
    members, ranks = members.persist(), ivf.centroid_ranks(asked, centroids).persist()
    truth = knn.block_top_k(vectors(spark, sf), asked, 10).persist()
    out = None
    for n in nprobes:
        probed = asked.join(ranks.filter(F.col("rank") <= n).select("query_id", "cluster_id"), "query_id")
        row = search.recall(ivf.search_probed(members, probed, 10), truth).select(F.lit(n).alias("nprobe"), "hits", "queries", "recall")
        out = row if out is None else out.unionByName(row)
    return out


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Publications: every event tries to publish a version named by its user."""
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("version"), F.col("event_id").alias("attempt"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    seqs = oplog(spark, sf).select("seq").distinct()
    named = seqs.select("seq", F.concat(F.lit("wal/"), F.lpad(F.col("seq").cast("string"), 20, "0"), F.lit(".bin")).alias("path"))
    return named.select("path", sequence_of().alias("seq"))


def _crc(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


_QUERIES: dict[str, Query] = {
    "knn_l2_single": _single(Metric.L2),
    "knn_cosine_single": _single(Metric.COSINE),
    "knn_dot_single": _single(Metric.DOT),
    "knn_l2_batch": _batch(Metric.L2),
    "knn_cosine_batch": _batch(Metric.COSINE),
    "knn_dot_batch": _batch(Metric.DOT),
    "knn_k_exceeds_n": _k_exceeds_n,
    "l2_pairwise": _pairwise,
    "oplog_from_events": oplog,
    "replay_lww": lambda spark, sf: replay.snapshot(oplog(spark, sf), DIM),
    "replay_after_seq": lambda spark, sf: replay.snapshot(oplog(spark, sf), DIM, AFTER),
    "replay_incremental": lambda spark, sf: replay.merge_snapshot(replay.snapshot(oplog(spark, sf).filter(F.col("seq") <= AFTER), DIM), oplog(spark, sf), DIM, AFTER),
    "touched_ids": lambda spark, sf: replay.touched(oplog(spark, sf), DIM, AFTER),
    "live_count": lambda spark, sf: replay.live_count(oplog(spark, sf), DIM),
    "max_seq": lambda spark, sf: replay.max_seq(oplog(spark, sf)),
    "group_commit_batches": _commits,
    "kmeans_seeds": lambda spark, sf: seeds(vectors(spark, sf)),
    "kmeans_assign": _seed_assign,
    "kmeans_update": lambda spark, sf: _round(vectors(spark, sf), seeds(vectors(spark, sf)))[1],
    "kmeans_empty_cluster": _empty_cluster,
    "kmeans_converged_flag": _converged,
    "kmeans_two_rounds": _two_rounds,
    "cluster_sizes": lambda spark, sf: km.sizes(_index(spark, sf)[0]),
    "cluster_offsets": _offsets,
    "centroid_rank": _centroid_rank,
    "nprobe_clusters": lambda spark, sf: _centroid_rank(spark, sf).filter("rank <= 5").select("query_id", "cluster_id"),
    "ivf_search_np1": lambda spark, sf: _probed(spark, sf, 1),
    "ivf_search_np5": lambda spark, sf: _probed(spark, sf, 5),
    "ivf_search_npall": lambda spark, sf: _probed(spark, sf, None),
    "ivf_anti_touched": lambda spark, sf: _probed(spark, sf, 5, replay.touched(oplog(spark, sf), DIM, AFTER)),
    "hybrid_search": _hybrid,
    "hybrid_after_delete": _after_delete,
    "recall_at_10": lambda spark, sf: _recall(spark, sf, (5,)),
    "recall_sweep": lambda spark, sf: _recall(spark, sf, (1, 5, 10, 20)),
    "manifest_winner": lambda spark, sf: catalog.winner(_attempts(spark, sf)),
    "wal_file_names": _names,
    "payload_crc32": _crc,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- SQL ---------------------------------------------------------------------------------------------------------


def _sum(a: str, b: str, term: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: {term}), lambda p, x: p + x)"


def _l2(a: str, b: str) -> str:
    return _sum(a, b, "(z[1] - z[2]) * (z[1] - z[2])")


def _dot(a: str, b: str) -> str:
    return _sum(a, b, "z[1] * z[2]")


def _cos(a: str, b: str) -> str:
    return f"(({_dot(a, b)})::DOUBLE / (sqrt(({_dot(a, a)})::DOUBLE) * sqrt(({_dot(b, b)})::DOUBLE)))::FLOAT"


_V = "v AS (SELECT vec_id::VARCHAR AS id, embedding AS vector FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)"
_LOG = """l AS (SELECT event_id // 100 + 1 AS seq, (event_id % 100)::INT AS op_idx, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::TINYINT AS op, user_id::VARCHAR AS id,
 CASE WHEN event_type = 'error' THEN NULL ELSE embedding END AS vector FROM events LEFT JOIN embeddings ON vec_id = event_id % 500 AND event_type <> 'error'),
 ok AS (SELECT * FROM l WHERE op = 1 OR len(vector) = 64)"""


def _live(name: str, where: str) -> str:
    return f"{name} AS (SELECT id, vector FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op_idx DESC) AS r FROM ok WHERE {where}) WHERE r = 1 AND op = 0)"


def _seeds_sql(rows: str, name: str = "c0") -> str:
    return f"{name} AS (SELECT (r - 1)::INT AS cluster_id, vector AS centroid FROM (SELECT *, row_number() OVER (ORDER BY md5(id), id) AS r FROM {rows}) WHERE r <= floor(sqrt((SELECT count(*) FROM {rows}))))"


def _assign_sql(rows: str, centroids: str, name: str) -> str:
    return f"{name} AS (SELECT id, vector, cluster_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster_id) AS r FROM (SELECT id, vector, cluster_id, {_l2('vector', 'centroid')} AS distance FROM {rows}, {centroids})) WHERE r = 1)"


def _update_sql(placed: str, centroids: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster_id, coalesce(mean, centroid) AS centroid, coalesce(n, 0)::BIGINT AS n FROM {centroids} LEFT JOIN (
 SELECT cluster_id, list(m ORDER BY j) AS mean, max(n) AS n FROM (
  SELECT cluster_id, j, (list_reduce(list(x::DOUBLE ORDER BY id), lambda p, x: p + x) / count(*))::FLOAT AS m, count(*) AS n
  FROM (SELECT cluster_id, id, unnest(vector) AS x, generate_subscripts(vector, 1) AS j FROM {placed}) GROUP BY 1, 2) GROUP BY 1) USING (cluster_id))"""


_ROUND1 = ", ".join([_V, _seeds_sql("v"), _assign_sql("v", "c0", "a0"), _update_sql("a0", "c0", "c1")])
_INDEX = _ROUND1 + ", " + _assign_sql("v", "c1", "a1")
_RANKS = f"ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cluster_id) AS rank FROM (SELECT query_id, q.vector, cluster_id, {_l2('q.vector', 'centroid')} AS distance FROM q, c1))"


def _top(source: str, score: str, order: str = "score") -> str:
    return f"SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id)::INT AS rank FROM (SELECT query_id, id, {score} AS score FROM {source})) WHERE rank <= 10"


def _ivf(where: str, members: str = "a1") -> str:
    return _top(f"(SELECT query_id, m.id, m.vector AS mv, ranks.vector AS qv FROM {members} m JOIN ranks USING (cluster_id) WHERE {where})", _l2("mv", "qv"))


def _hybrid_sql(extra: str = "") -> str:
    log = f"{_LOG.replace('ok AS (SELECT * FROM l', f'ok AS (SELECT * FROM (SELECT * FROM l {extra})')}"
    c = _RANKS.replace("FROM q, c1", "FROM q, c0")
    parts = [_V, log, _live("covered", f"seq <= {AFTER}"), _live("recent", f"seq > {AFTER}"), f"t AS (SELECT DISTINCT id FROM ok WHERE seq > {AFTER})", _seeds_sql("covered"), _assign_sql("covered", "c0", "a1"), c]
    old = f"SELECT query_id, m.id, m.vector AS mv, ranks.vector AS qv FROM a1 m JOIN ranks USING (cluster_id) WHERE rank <= 3 AND m.id NOT IN (SELECT id FROM t)"
    return f"WITH {', '.join(parts)} {_top(f'({old} UNION ALL SELECT query_id, r.id, r.vector, q.vector FROM recent r, q)', _l2('mv', 'qv'))}"


def _recall_sql(nprobes: tuple[int, ...]) -> str:
    truth = f"truth AS ({_top('(SELECT query_id, v.id, v.vector AS mv, q.vector AS qv FROM v, q)', _l2('mv', 'qv'))})"
    rows = [f"SELECT {n}::INT AS nprobe, (SELECT count(*) FROM ({_ivf(f'rank <= {n}')}) SEMI JOIN truth USING (query_id, id)) AS hits, (SELECT count(*) FROM q) AS queries" for n in nprobes]
    return f"WITH {_INDEX}, {_RANKS}, {truth} SELECT nprobe, hits, queries, hits::DOUBLE / (queries * 10) AS recall FROM ({' UNION ALL '.join(rows)})"


def _one(score: str, order: str, limit: str = "LIMIT 10") -> str:
    return f"WITH {_V}, o AS (SELECT vector AS o FROM v WHERE id = '0') SELECT id, {score} AS score FROM v, o ORDER BY {order}, id {limit}"


def oracle_sql() -> dict[str, str]:
    pairs = "(SELECT query_id, v.id, v.vector AS mv, q.vector AS qv FROM v, q)"
    log = f"WITH {_LOG}"
    return {
        "knn_l2_single": _one(_l2("vector", "o"), "score"),
        "knn_cosine_single": _one(_cos("vector", "o"), "score DESC"),
        "knn_dot_single": _one(_dot("vector", "o"), "score DESC"),
        "knn_l2_batch": f"WITH {_V} {_top(pairs, _l2('mv', 'qv'))}",
        "knn_cosine_batch": f"WITH {_V} {_top(pairs, _cos('mv', 'qv'), 'score DESC')}",
        "knn_dot_batch": f"WITH {_V} {_top(pairs, _dot('mv', 'qv'), 'score DESC')}",
        "knn_k_exceeds_n": _one(_l2("vector", "o"), "score", "LIMIT (SELECT count(*) + 1 FROM embeddings)"),
        "l2_pairwise": f"WITH {_V} SELECT query_id, id, {_l2('mv', 'qv')} AS score FROM {pairs}",
        "oplog_from_events": f"{log} SELECT * FROM l",
        "replay_lww": f"{log}, {_live('s', 'true')} SELECT * FROM s",
        "replay_after_seq": f"{log}, {_live('s', f'seq > {AFTER}')} SELECT * FROM s",
        "replay_incremental": f"{log}, {_live('s', 'true')} SELECT * FROM s",
        "touched_ids": f"{log} SELECT DISTINCT id FROM ok WHERE seq > {AFTER}",
        "live_count": f"{log}, {_live('s', 'true')} SELECT count(*) AS live FROM s",
        "max_seq": f"{log} SELECT max(seq) AS max_seq FROM l",
        "group_commit_batches": "SELECT event_id // 100 + 1 AS seq, count(*) AS n_ops, count(*) FILTER (event_type = 'error') AS n_deletes FROM events GROUP BY 1",
        "kmeans_seeds": f"WITH {_V}, {_seeds_sql('v')} SELECT * FROM c0",
        "kmeans_assign": f"WITH {_ROUND1} SELECT id, cluster_id, distance FROM a0",
        "kmeans_update": f"WITH {_ROUND1} SELECT cluster_id, centroid, n FROM c1",
        "kmeans_empty_cluster": f"WITH {_V}, {_seeds_sql('v', 's0')}, c0 AS (SELECT * FROM s0 UNION ALL SELECT floor(sqrt((SELECT count(*) FROM v)))::INT, list_transform(range(64), lambda x: {FAR}::FLOAT)), {_assign_sql('v', 'c0', 'a0')}, {_update_sql('a0', 'c0', 'c1')} SELECT cluster_id, centroid, n FROM c1",
        "kmeans_converged_flag": f"WITH {_INDEX} SELECT bool_or(a0.cluster_id <> a1.cluster_id) AS changed FROM a0 JOIN a1 USING (id)",
        "kmeans_two_rounds": f"WITH {_INDEX}, {_update_sql('a1', 'c1', 'c2').replace('SELECT cluster_id, coalesce(mean, centroid) AS centroid, coalesce(n, 0)', 'SELECT cluster_id, coalesce(mean, centroid) AS centroid, coalesce(u.n, 0)').replace(') USING (cluster_id)', ') u USING (cluster_id)')} SELECT cluster_id, centroid, n FROM c2",
        "cluster_sizes": f"WITH {_INDEX} SELECT cluster_id, count(*) AS n FROM a1 GROUP BY 1",
        "cluster_offsets": f"WITH {_INDEX} SELECT cluster_id, coalesce(sum(length) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT cluster_id, sum(2 + strlen(id) + 4 * len(vector)) + 4 AS length FROM a1 GROUP BY 1)",
        "centroid_rank": f"WITH {_ROUND1}, {_RANKS} SELECT query_id, cluster_id, distance, rank::INT AS rank FROM ranks",
        "nprobe_clusters": f"WITH {_ROUND1}, {_RANKS} SELECT query_id, cluster_id FROM ranks WHERE rank <= 5",
        "ivf_search_np1": f"WITH {_INDEX}, {_RANKS} {_ivf('rank <= 1')}",
        "ivf_search_np5": f"WITH {_INDEX}, {_RANKS} {_ivf('rank <= 5')}",
        "ivf_search_npall": f"WITH {_V} {_top(pairs, _l2('mv', 'qv'))}",
        "ivf_anti_touched": f"WITH {_INDEX}, {_RANKS}, {_LOG} {_ivf(f'rank <= 5 AND m.id NOT IN (SELECT id FROM ok WHERE seq > {AFTER})')}",
        "hybrid_search": _hybrid_sql(),
        "hybrid_after_delete": _hybrid_sql("UNION ALL SELECT 1099511627776, 0::INT, 1::TINYINT, user_id::VARCHAR, NULL FROM events GROUP BY user_id HAVING count(*) % 2 = 1"),
        "recall_at_10": _recall_sql((5,)),
        "recall_sweep": _recall_sql((1, 5, 10, 20)),
        "manifest_winner": "SELECT user_id AS version, min(event_id) AS attempt FROM events GROUP BY 1",
        "wal_file_names": "SELECT DISTINCT 'wal/' || lpad((event_id // 100 + 1)::VARCHAR, 20, '0') || '.bin' AS path, event_id // 100 + 1 AS seq FROM events",
    }
