import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quiverlake import catalogue, stored

SQL = catalogue.oracle_sql() | stored.oracle_sql()
QUERIES = catalogue.queries() | stored.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("embeddings", "events", "region", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(plain(tuple(r))) for r in got.collect()) == sorted(repr(plain([r[i] for i in order])) for r in want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_payload_checksums(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    got = {r.event_id: r.crc for r in catalogue.queries()["payload_crc32"](spark, sf_dir).collect()}
    assert got == {r.event_id: None if r.props is None else zlib.crc32(r.props.encode()) for r in events}


def test_kmeans_loop(spark, sf_dir):
    """The loop to convergence against numpy, from the same seeds; sums in double, centroids in single precision."""
    rows = catalogue.vectors(spark, sf_dir)
    x = np.array([r.vector for r in rows.collect()], dtype=np.float32).astype(float)
    now = np.array([r.centroid for r in catalogue.seeds(rows).orderBy("cluster_id").collect()], dtype=np.float32)
    for _ in range(25):
        near = ((x[:, None, :] - now[None].astype(float)) ** 2).sum(axis=2).argmin(axis=1)
        before, now = now, np.array([x[near == c].mean(axis=0) if (near == c).any() else now[c] for c in range(len(now))], dtype=np.float32)
        if np.array_equal(before, now):
            break
    got = stored.queries()["kmeans_loop"](spark, sf_dir).orderBy("cluster_id").collect()
    assert np.allclose(np.array([r.centroid for r in got]), now, atol=1e-5)
