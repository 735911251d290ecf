import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import kmeans as km
from quiverlake.operators import knn, replay
from quiverlake.schema import OPLOG, VECTORS, split_valid

LOG = [
    (1, 0, 0, "a", [1.0, 0.0]), (1, 1, 0, "b", [0.0, 1.0]), (2, 0, 1, "a", None), (3, 0, 0, "a", [2.0, 2.0]),
    (3, 1, 0, "c", [5.0, 5.0]), (3, 2, 1, "c", None), (4, 0, 1, "z", None), (5, 0, 0, "b", [1.0, 2.0, 3.0]), (6, 0, 7, "b", None),
]


def log(spark, rows=LOG):
    return spark.createDataFrame(rows, OPLOG)


def test_last_write_wins(spark):
    got = {r.id: r.vector for r in replay.snapshot(log(spark), 2).collect()}
    assert got == {"a": [2.0, 2.0], "b": [0.0, 1.0]}
    assert {r.id for r in replay.touched(log(spark), 2, 2).collect()} == {"a", "c", "z"}
    assert replay.max_seq(log(spark)).first().max_seq == 6
    assert replay.max_seq(log(spark).limit(0)).first().max_seq == 0
    assert replay.live_count(log(spark), 2).first().live == 2


def test_replay_splits_anywhere_and_in_any_order(spark):
    whole = sorted(map(tuple, ((r.id, tuple(r.vector)) for r in replay.snapshot(log(spark).repartition(7, "op_idx"), 2).collect())))
    for c in range(7):
        base = replay.snapshot(log(spark).filter(F.col("seq") <= c), 2)
        got = replay.merge_snapshot(base, log(spark), 2, c)
        assert sorted((r.id, tuple(r.vector)) for r in got.collect()) == whole


def test_split_valid(spark):
    rows = [(0, "a", [1.0, 2.0]), (0, "", [1.0, 2.0]), (0, None, [1.0, 2.0]), (0, "a", [1.0]), (0, "a", None), (1, "a", None), (9, "a", None), (0, "x" * 65_536, [1.0, 2.0])]
    good, bad = split_valid(spark.createDataFrame(rows, "op tinyint, id string, vector array<float>"), 2)
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["empty id", "empty id", "id too long", "unknown operation", "wrong vector length", "wrong vector length"]


def points(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def test_top_k_edges(spark):
    rows = points(spark, [("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("c", [9.0, 9.0])])
    assert [r.id for r in knn.top_k(rows, [0.0, 0.0], 1).collect()] == ["a"]  # a tie goes to the smaller id
    assert [r.id for r in knn.top_k(rows, [0.0, 0.0], 10).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        knn.top_k(rows, [0.0, 0.0], 0)
    with pytest.raises(Exception, match="lengths differ"):
        knn.top_k(rows, [0.0, 0.0, 0.0], 1).collect()
    zero = points(spark, [("a", [0.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [1.0, 0.0])])
    assert [r.id for r in knn.top_k(zero, [2.0, 0.0], 3, "cosine").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_block_search_equals_columns(spark, metric):
    dice = np.random.default_rng(3)
    x = np.round(dice.standard_normal((300, 5)), 1)  # many ties
    x[5] = 0
    rows = points(spark, [(f"é{i}", v) for i, v in enumerate(x.tolist())]).repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(x[:7].tolist())], "query_id bigint, vector array<float>")
    same = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect() if r.score is not None)
    assert same(knn.block_top_k(rows, queries, 9, metric, block=3)) == same(knn.batch_top_k(rows, queries, 9, metric))
    assert knn.block_top_k(rows, queries.limit(0), 9, metric).count() == 0


def test_kmeans_rules(spark):
    rows = points(spark, [("a", [0.0]), ("b", [2.0]), ("c", [1.0]), ("d", [10.0])])
    start = km.centroid_frame(rows, [[0.0], [2.0], [99.0]])
    placed = {r.id: r.cluster_id for r in km.assign(rows, start).collect()}
    assert placed == {"a": 0, "b": 1, "c": 0, "d": 1}  # c is a tie: the lower cluster
    after = {r.cluster_id: (r.centroid, r.n) for r in km.update(rows.join(km.assign(rows, start), "id"), start).collect()}
    assert after == {0: ([0.5], 2), 1: ([6.0], 2), 2: ([99.0], 0)}  # the empty cluster keeps its centroid
    centroids, assigned = km.kmeans(rows, start, 25)
    assert sorted(r.centroid[0] for r in centroids.collect()) == [1.0, 10.0, 99.0]
    assert {r.id: r.cluster_id for r in assigned.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}
    assert {r.cluster_id for r in km.kmeans(rows, start, 0)[1].collect()} == {0}
    assert km.seed_centroids(rows, 9).count() == 4


def test_kmeans_blocks_equal_columns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    start = km.seed_centroids(rows, 7, seed=5)
    x = np.array([r.centroid for r in start.orderBy("cluster_id").collect()], np.float32)
    a = {r.id: r.cluster_id for r in km.assign(rows, start).collect()}
    assert a == {r.id: r.cluster_id for r in km.assign_blocks(rows, x).collect()}
    once = km.kmeans(rows, start, 1)[0]
    plain = km.update(rows.join(km.assign(rows, start), "id"), start)
    got, want = ({r.cluster_id: r.centroid for r in df.collect()} for df in (once, plain))
    assert all(np.allclose(got[c], want[c], rtol=0, atol=1e-7) for c in want)


def test_library_kmeans(spark):
    rows = points(spark, [(f"{i}", [float(i % 2 * 100 + i % 7), 1.0]) for i in range(60)])
    centroids, assigned = km.kmeans_fast(rows, 2, seed=3)
    assert centroids.count() == 2 and sorted(r.n for r in km.sizes(assigned).collect()) == [30, 30]
