import json
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quiverlake import service
from quiverlake.operators import knn, replay
from quiverlake.plans import catalog, ivf, search
from quiverlake.schema import OPLOG
from quiverlake.sources.binlog import read_oplog
from quiverlake.sources.store import Store, scan_metrics
from quiverlake.streaming import ingest, state


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def make(v, seq=10):
    return catalog.Manifest(v, "x", seq, 128, 5)


def test_manifest(spark, store):
    with pytest.raises(catalog.NoManifestError):
        catalog.latest(store)
    for v in (1, 2, 3):
        catalog.publish(store, make(v, v * 10))
    assert catalog.latest(store) == make(3, 30)
    assert catalog.history(spark, store).count() == 3
    store.create("manifest/00000000000000000009.json", json.dumps(make(8).__dict__).encode())
    with pytest.raises(catalog.CorruptManifestError):
        catalog.latest(store)


def test_twenty_publishers_one_winner(store):
    catalog.publish(store, make(1))
    won, lost = [], []

    def run(i):
        try:
            catalog.publish(store, make(2, 100 + i))
            won.append(100 + i)
        except catalog.ConflictError:
            lost.append(i)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 19 and catalog.latest(store).index_seq == won[0]


def embeddings_log(spark, sf_dir, seq=1):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.lit(seq).cast("bigint").alias("seq"), F.col("vec_id").cast("int").alias("op_idx"), F.lit(0).cast("tinyint").alias("op"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def queries_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_index_search_and_pruning(spark, sf_dir, store):
    log = embeddings_log(spark, sf_dir)
    status, manifest = ivf.build_index(spark, store, log, k=12, max_iter=5)
    assert status == "published" and manifest.version == 1 and manifest.k == 12
    index = ivf.open_latest(spark, store)
    queries = queries_of(spark, sf_dir)
    truth = knn.batch_top_k(replay.snapshot(log), queries, 10)
    assert rows_of(index.search(queries, 10, nprobe=12)) == rows_of(truth)
    last = 0.0
    for n in (1, 3, 6, 12):
        found = search.recall(index.search(queries, 10, n), truth).first().recall
        assert found >= last
        last = found
    assert last == 1.0
    vector = queries.first().vector
    one = index.search_one(vector, 10, nprobe=3)
    one.collect()
    assert scan_metrics(one)["numPartitions"] <= 3  # from the executed scan, not from the plan's text
    probes, union = index.probes(queries, 2)
    many = index.search(queries, 10, 2)
    many.collect()
    assert scan_metrics(many)["numPartitions"] <= len(union)
    with pytest.raises(ValueError):
        index.search_one([1.0], 1)
    base = catalog.latest(store).version
    catalog.publish(store, catalog.Manifest(base + 1, manifest.index, manifest.index_seq, manifest.dim, manifest.k))
    assert ivf.build_index(spark, store, log, k=2, max_iter=1)[1].version == base + 2
    with pytest.raises(ValueError, match="no live vector"):
        ivf.build_index(spark, store, log.limit(0))


def test_hybrid_equals_brute_force_at_full_probe(spark, sf_dir, store):
    old = embeddings_log(spark, sf_dir)
    ivf.build_index(spark, store, old, k=8, max_iter=3)
    index = ivf.open_latest(spark, store)
    v = old.filter("id = '3'").first().vector
    fresh = spark.createDataFrame([(2, 0, 1, "5", None), (2, 1, 0, "0", [0.5] * 64), (3, 0, 0, "new", v), (3, 1, 1, "ghost", None), (3, 2, 0, "7", [1.0])], OPLOG)
    log, queries = old.unionByName(fresh), queries_of(spark, sf_dir)
    want = knn.batch_top_k(replay.snapshot(log, 64), queries, 10)
    assert rows_of(search.hybrid(queries, 10, log, index, nprobe=8)) == rows_of(want)
    assert rows_of(search.hybrid(queries, 10, log, None, dim=64)) == rows_of(want)
    with pytest.raises(Exception, match="64 are needed"):
        search.hybrid(spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<float>"), 1, log, index).collect()


def test_stream_commits_once(spark, store, tmp_path):
    requests, checkpoint, rejects = (tmp_path / n for n in ("in", "cp", "bad"))
    requests.mkdir()
    body = lambda *rows: "\n".join(json.dumps(r) for r in rows)
    (requests / "1.json").write_text(body({"id": "a", "vector": [1, 2]}, {"id": "b", "vector": [3, 4]}, {"id": "bad", "vector": [1]}))
    ingest.start(spark, str(requests), store, str(checkpoint), 2, str(rejects)).awaitTermination()
    (requests / "2.json").write_text(body({"op": "delete", "id": "a"}, {"id": "c", "vector": [5, 6]}))
    ingest.start(spark, str(requests), store, str(checkpoint), 2, str(rejects)).awaitTermination()
    assert ingest.last_seq(store) == 2 and spark.read.parquet(str(rejects)).count() == 1
    log = read_oplog(spark, store.path("wal"))
    assert {r.id: r.vector for r in replay.snapshot(log, 2).collect()} == {"b": [3.0, 4.0], "c": [5.0, 6.0]}
    same = [(1, "a", None), (0, "c", [5.0, 6.0])]
    assert ingest.commit(store, 2, same) == 2 and read_oplog(spark, store.path("wal")).count() == 4  # its own file
    writer = ingest.Writer(store, 2)
    assert writer.write([(0, "d", [1.0, 1.0])]) == 3
    with pytest.raises(ValueError):
        writer.write([(0, "d", [1.0])])
    assert writer.seq == 3


def test_stream_on_a_log_with_files(spark, store, tmp_path):
    """Service writes, then a stream with a new checkpoint: nothing is lost, in groups of 100; nor by a batch run again."""
    writer = ingest.Writer(store, 1)
    assert writer.write([(0, "service", [0.5])]) == 1
    requests = tmp_path / "in"
    requests.mkdir()
    (requests / "1.json").write_text("\n".join(json.dumps({"id": f"s{i}", "vector": [i]}) for i in range(250)))
    ingest.start(spark, str(requests), store, str(tmp_path / "cp"), 1).awaitTermination()
    log = read_oplog(spark, store.path("wal"))
    assert {r.seq: r["count"] for r in log.groupBy("seq").count().collect()} == {1: 1, 2: 100, 3: 100, 4: 50}
    assert replay.live_count(log, 1).first().live == 251
    # The first file of a batch that failed half way, then a file of another writer; the batch comes again.
    groups = [[(0, f"r{i}", [1.0])] for i in range(3)]
    first = ingest.begin(store, "again", 7)
    assert first == 5 and ingest.commit(store, first, groups[0]) == 5 and writer.write([(0, "other", [2.0])]) == 6
    seq = ingest.begin(store, "again", 7)
    for g in groups:
        seq = ingest.commit(store, seq, g) + 1
    found = {r.id: r.seq for r in read_oplog(spark, store.path("wal"), 4).collect()}
    assert found == {"r0": 5, "other": 6, "r1": 7, "r2": 8}


def test_writer_commits_groups(store):
    writer = ingest.Writer(store, 1, wait=0.2)
    with ThreadPoolExecutor(60) as pool:
        seqs = list(pool.map(lambda i: writer.write([(0, f"w{i}", [1.0])]), range(60)))
    assert sorted(set(seqs)) == list(range(1, max(seqs) + 1)) and len(store.list("wal/")) == max(seqs) < 10
    broken = ingest.Writer(store, 1, wait=0.2)

    def fail(*_):
        raise OSError("no room")

    broken.store = type("Broken", (), {"create": fail})()
    with ThreadPoolExecutor(5) as pool:
        waiting = [pool.submit(broken.write, [(0, "x", [1.0])]) for _ in range(5)]
        assert all("no room" in str(w.exception()) for w in waiting)


def test_group_commits(spark):
    ops = spark.range(250).withColumnRenamed("id", "n")
    got = ingest.group_commits(ops, "n").groupBy("seq").agg(F.count("*").alias("c"), F.max("op_idx").alias("m")).orderBy("seq").collect()
    assert [(r.seq, r.c, r.m) for r in got] == [(1, 100, 99), (2, 100, 99), (3, 50, 49)]


def test_keyed_state(spark, tmp_path):
    rows = [(1, 0, 0, "a", [1.0]), (2, 0, 1, "a", None), (2, 1, 0, "b", [1.0])]
    spark.createDataFrame(rows, OPLOG).coalesce(1).write.json(str(tmp_path / "ops"))
    stream = state.live_updates(spark.readStream.schema(OPLOG).json(str(tmp_path / "ops")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: r.alive for r in spark.table("live").collect()} == {"a": False, "b": True}


def test_service(spark, tmp_path):
    engine = service.Engine(spark, str(tmp_path), dim=2)
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert post("/query", {"vector": [0, 0], "k": 1}) == (200, {"results": []})
    assert post("/write", {"id": "a", "vector": [1, 0]}) == (200, {"id": "a"})
    assert post("/write", {"id": "b", "vector": [3, 4]})[0] == 200
    assert post("/delete", {"id": "never"}) == (200, {"id": "never"})
    assert post("/query", {"vector": [0, 0], "k": 9}) == (200, {"results": [{"id": "a", "score": 1.0}, {"id": "b", "score": 25.0}]})
    for bad in (b"{", {"id": "", "vector": [1, 2]}, {"id": "x", "vector": [1]}):
        assert post("/write", bad)[0] == 400
    assert post("/query", {"vector": [0, 0], "k": 0})[0] == 400 and post("/query", {"vector": [0], "k": 1})[0] == 400 and post("/none", {})[0] == 404
    ivf.build_index(spark, engine.store, read_oplog(spark, engine.store.path("wal")), max_iter=2)
    engine.refresh()
    assert post("/delete", {"id": "a"})[0] == 200
    engine.store.calls.clear()
    assert post("/query", {"vector": [0, 0], "k": 9})[1] == {"results": [{"id": "b", "score": 25.0}]}
    reads = engine.store.calls["read"]
    assert post("/query", {"vector": [0, 0], "k": 9})[1] == {"results": [{"id": "b", "score": 25.0}]}
    assert engine.store.calls["read"] == reads and engine.steps == 1  # nothing new: answered from memory
    server.shutdown()
