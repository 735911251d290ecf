import numpy as np
import pytest

from quiverlake.llm import forest


def brute(rows, k=10, every=100):
    good = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = sorted(set(good))
    x = np.array([v for _, v in good], dtype=np.float32).astype(float)
    out = {}
    for i, v in good:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v, dtype=np.float32).astype(float)) ** 2).sum(axis=1))
            out[i] = sorted((s, o) for s, (o, _) in zip(d.tolist(), good, strict=True) if o != i)[:k]
    return out


def compare(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, len(mine) + 1))
        assert len(mine) == len(best)
        hits += len({r.vec_id for r in mine} & {o for _, o in best})
        total += len(best)
        exact = dict((o, s) for s, o in best)
        assert all(abs(exact[r.vec_id] - r.score) < 1e-12 for r in mine if r.vec_id in exact)
    assert {r.query_id for r in got} <= set(want)
    return hits / max(1, total)


def test_recall_on_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert compare(forest.nearest(table).collect(), brute(rows)) >= 0.9


def test_edges(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (0, v), (100, v), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 0.0, 0.0]), (None, v), (200, [-1.0, 0.0, 1.0])]
    rows += [(1000 + i, v) for i in range(1, 40)] + [(2001 + i, [1.0, 0.5, 2.0 + i]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("bucket", forest.F.lit("x"))
    want = brute(rows)
    got = forest.nearest(table).collect()
    assert compare(got, want) == 1.0
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 0) == [(i + 1, o) for i, (_, o) in enumerate(want[0])]
    assert forest.nearest(table.limit(0)).count() == 0


def vectors(kind, n, dim=16):
    dice = np.random.default_rng(7)
    noise = dice.standard_normal((n, dim))
    if kind == "clusters":
        return dice.standard_normal((40, dim))[dice.integers(40, size=n)] * 3 + noise * 0.5
    if kind == "cone":  # a common offset and a few long axes
        return noise * np.geomspace(4, 0.2, dim) + 30
    return noise


@pytest.mark.parametrize(("kind", "bits"), [("clusters", 8), ("clusters", 10), ("cone", 8), ("cone", 10), ("random", 8)])
def test_coarse_buckets(spark, monkeypatch, kind, bits):
    """Recall with many coarse bits, and that buckets are left out where the vectors have structure."""
    n = 8192
    monkeypatch.setattr(forest, "BUCKET", n >> bits)
    monkeypatch.setattr(forest, "CHUNK", 64)
    x = vectors(kind, n).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    asked = []
    measured = forest._probes
    monkeypatch.setattr(forest, "_probes", lambda *a: asked.append(measured(*a)) or asked[0])
    recall = compare(forest.nearest(table).collect(), brute(list(enumerate(x.tolist()))))
    print(kind, bits, "bits:", asked[0], "buckets,", "recall", round(recall, 3))
    assert recall >= 0.9 and (kind == "random" or asked[0] < 1 << (bits - 1))


def test_all_buckets_is_exact_where_chunks_are_small(spark, monkeypatch):
    monkeypatch.setattr(forest, "BUCKET", 64)
    monkeypatch.setattr(forest, "CHUNK", 32)
    x = vectors("random", 2000).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    assert compare(forest.nearest(table, recall=1).collect(), brute(list(enumerate(x.tolist())))) == 1.0


def test_uneven_buckets_are_dealt_into_small_chunks():
    """Two thirds of the rows on one spot, nearly: medians still cut, and what they cannot cut is dealt."""
    dice = np.random.default_rng(1)
    x = np.vstack([dice.standard_normal((1000, 4)), 1 + dice.standard_normal((2000, 4)) * 1e-9])
    coarse = forest.Coarse(x, 6)
    assert np.bincount(coarse.buckets(x), minlength=64).max() < 1500
    near = coarse.nearest(x[:5], 64)
    assert all(sorted(row) == list(range(64)) for row in near.tolist())
