import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import distance as d


def table(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


@pytest.mark.parametrize(("metric", "value"), [("l2", 25.0), ("dot", 0.0), ("cosine", 0.0)])
def test_goldens(spark, metric, value):
    assert table(spark, [3.0, 0.0], [0.0, 4.0]).select(d.score(metric, F.col("a"), F.col("b"))).first()[0] == value


def test_cosine_of_scaled_and_zero(spark):
    pick = lambda a, b: table(spark, a, b).select(d.cosine_similarity(F.col("a"), F.col("b"))).first()[0]
    assert pick([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1.0)
    assert pick([1.0, 0.0], [-7.0, 0.0]) == -1.0
    assert pick([0.0, 0.0], [1.0, 0.0]) is None


def test_length_mismatch_is_an_error(spark):
    for f in (d.l2_squared, d.dot_product, d.cosine_similarity):
        with pytest.raises(Exception, match="vector lengths differ"):
            table(spark, [1.0, 2.0], [1.0]).select(f(F.col("a"), F.col("b"))).collect()
    with pytest.raises(ValueError, match="lengths differ"):
        d.score_matrix("l2", np.zeros((1, 2)), np.zeros((1, 3)))
    with pytest.raises(ValueError, match="unknown metric"):
        d.as_metric("hamming")


def test_numpy_kernel_has_the_same_bits(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x * F.lit(3).cast("float")).alias("v"))
    q = rows.filter("vec_id = 7").first().v
    lit = F.array(*[F.lit(x).cast("float") for x in q])
    got = rows.select("vec_id", "v", *[d.score(m, F.col("v"), lit).alias(m.name) for m in d.Metric]).collect()
    x = np.array([r.v for r in got], np.float32)
    for m in d.Metric:
        assert np.array_equal(d.score_matrix(m, np.array([q]), x)[0], np.array([r[m.name] for r in got], np.float32))
