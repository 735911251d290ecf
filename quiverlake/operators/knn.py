"""Exact nearest neighbours (P1, J1, T1): one query, or a table of queries in blocks.

Ties go to the smaller id in byte order. k above the number of vectors gives them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import DESCENDING, Metric, as_metric, best_first, score, score_matrix
from ..schema import check_k

#: Query vectors that are sent to every task at once; more are worked off block by block.
QUERY_BLOCK = 4096


def top_k(vectors: DataFrame, query: list[float], k: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """(id, score), best first: a scan, a projection and a bounded top-k in each task."""
    dim = len(query)
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = vectors.select("id", score(metric, F.col("vector"), q).alias("score")) if dim else vectors.limit(0)
    return scored.orderBy(best_first(metric), "id").limit(check_k(k))


def rank(scored: DataFrame, k: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """The k best rows of each query_id with their rank; tasks drop all but k of a query before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(best_first(metric), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= check_k(k))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """(query_id, rank, id, score) by Column expressions: a broadcast nested loop, for at most QUERY_BLOCK queries."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return block_top_k(vectors, queries, k, metric)
    pairs = vectors.crossJoin(F.broadcast(queries.select("query_id", F.col("vector").alias("query"))))
    scored = pairs.select("query_id", "id", score(metric, F.col("vector"), F.col("query")).alias("score"))
    return rank(scored, k, metric).select("query_id", "rank", "id", "score")


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.L2, block: int = QUERY_BLOCK) -> DataFrame:
    """As batch_top_k, with a numpy kernel of the same bits: each task keeps only its k best of every query.

    Queries reach the driver a block at a time, so a table of any size can be asked; the vectors are scanned once
    for each block.
    """
    metric, k = as_metric(metric), check_k(k)
    rows = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator(prefetchPartitions=True)
    out, part = None, []

    def search(part: list) -> DataFrame:
        names = [r.query_id for r in part]
        matrix = np.array([r.vector for r in part], dtype=np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scores = [np.zeros(0, object)] * len(names), [np.zeros(0, np.float32)] * len(names)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    x = piece.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                    own = np.array(piece.column("id").to_pylist(), dtype=object)
                    for i, s in enumerate(score_matrix(metric, matrix, x)):
                        order = -s if metric in DESCENDING else s
                        keep = np.arange(len(s))
                        if len(s) > k:
                            cut = np.partition(order, k - 1)[k - 1]
                            keep = np.flatnonzero((order <= cut) | np.isnan(order) & np.isnan(cut))
                        ids[i], scores[i] = np.concatenate([ids[i], own[keep]]), np.concatenate([scores[i], s[keep]])
                        if len(ids[i]) > 8 * k:
                            ids[i], scores[i] = _best(ids[i], scores[i], k, metric)
            for i, name in enumerate(names):
                a, s = _best(ids[i], scores[i], k, metric)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.int64()), pa.array(a.tolist(), pa.string()), pa.array(s, pa.float32(), from_pandas=True)], ["query_id", "id", "score"])

        found = vectors.select("id", "vector").mapInArrow(run, "query_id bigint, id string, score float")
        return rank(found, k, metric).select("query_id", "rank", "id", "score")

    for row in rows:
        part.append(row)
        if len(part) == block:
            out = search(part) if out is None else out.unionByName(search(part))
            part = []
    if part or out is None:
        last = search(part) if part else batch_top_k(vectors.limit(0), queries.limit(0), k, metric)
        out = last if out is None else out.unionByName(last)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    key = np.where(np.isnan(scores), np.inf, -scores if metric in DESCENDING else scores)
    order = sorted(range(len(ids)), key=lambda i: (key[i], ids[i].encode()))[:k]
    return ids[order], scores[order]
