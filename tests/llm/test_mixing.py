import duckdb
import pytest

from quiverlake.llm import mixing


def test_sql_oracle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = mixing.replicate(docs).select("doc_id", "source", "copy_no", "mix_key").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(mixing.oracle()).fetchall())
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)


def many(spark):
    return spark.range(6000).selectExpr("id AS doc_id", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END) AS source", "repeat('x', 99) AS text")


def test_targets_are_met(spark):
    targets = {"s0": 0.1, "s1": 0.6, "s2": 0.3, "absent": 0.0}
    out = mixing.replicate(many(spark), targets).groupBy("source").count().collect()
    total = sum(r["count"] for r in out)
    assert {r.source for r in out} == {"s0", "s1", "s2"} and total == pytest.approx(6000, rel=0.05)
    for r in out:
        assert r["count"] / total == pytest.approx(targets[r.source], abs=0.02)


def test_high_rates_add_up(spark):
    few = spark.createDataFrame([(i, "a", "x" * 9) for i in range(20)] + [(100, "b", "x" * 9)], "doc_id bigint, source string, text string")
    out = mixing.replicate(few, {"a": 1.0}, budget=20 * 10 * 300.0)
    assert out.count() == pytest.approx(6000, rel=0.05) and out.filter("source = 'b'").isEmpty()


def test_same_whatever_the_partitioning(spark):
    a, b = (sorted(map(tuple, mixing.replicate(many(spark).repartition(n)).select("doc_id", "copy_no").collect())) for n in (1, 9))
    assert a == b


def test_join_without_broadcast(spark, monkeypatch):
    want = mixing.replicate(many(spark)).count()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert mixing.replicate(many(spark)).count() == want


def test_edges(spark):
    rows = [(1, None, None, "k"), (1, None, None, "k"), (None, "a", "", "k"), (3, "a", "t" * 90_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copy_no string")
    out = mixing.replicate(docs)
    assert out.columns == ["doc_id", "source", "text", "copy_no", "mix_key"]
    twice = out.filter("doc_id = 1").groupBy("copy_no").count().collect()
    assert all(r["count"] == 2 for r in twice)
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_working_names_are_free(spark):
    docs = many(spark).withColumns({"__ql_src": mixing.F.lit(1), "__ql_n": mixing.F.lit("n"), "__ql_cdf": mixing.F.lit(2), "__QL_parts": mixing.F.lit(3)})
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "copy_no", "mix_key"] and out.count() == mixing.replicate(many(spark)).count()
