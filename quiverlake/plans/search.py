"""Search over an index and the writes that it does not cover yet (J4, U1, U2, T4), and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import block_top_k, rank
from ..operators.replay import snapshot, touched
from ..schema import check_k
from .ivf import Index


def merge(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of several result tables of the same queries."""
    both = parts[0].select("query_id", "id", "score")
    for p in parts[1:]:
        both = both.unionByName(p.select("query_id", "id", "score"))
    return rank(both, k).select("query_id", "rank", "id", "score")


def hybrid(queries: DataFrame, k: int, log: DataFrame, index: Index | None = None, nprobe: int = 10, dim: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): exact over recent writes, probed over the index without the ids they touched.

    All parts read the same log table, so the answer is of one snapshot.
    """
    check_k(k)
    dim = index.dim if index else dim
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit("query vector has "), F.size("vector").cast("string"), F.lit(f" numbers; {dim} are needed")))
        queries = queries.select("query_id", F.when(F.size("vector") == dim, F.col("vector")).otherwise(wrong.cast("array<float>")).alias("vector"))
    after = index.seq if index else 0
    recent = block_top_k(snapshot(log, dim, after), queries, k)  # any number of queries
    if index is None:
        return recent
    return merge([recent, index.search(queries, k, nprobe, skip=touched(log, dim, after))], k)


def recall(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of true neighbours found; results and truth are (query_id, id)."""
    found = results.select("query_id", "id").join(truth.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    hits = found.agg(F.count(F.lit(1)).alias("hits"))
    asked = truth.agg(F.count_distinct("query_id").alias("queries"))
    return hits.crossJoin(asked).select("hits", "queries", F.try_divide(F.col("hits").cast("double"), F.col("queries") * F.lit(k)).alias("recall"))
