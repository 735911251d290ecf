import struct
import threading

import numpy as np
import pytest

from quiverlake import sources
from quiverlake.schema import OPLOG
from quiverlake.sources import binindex, binlog, vecfiles
from quiverlake.sources.store import ExistsError, Store, json_requests


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def test_store_contract(store):
    for name in ("p/b.bin", "p/c.bin", "p/a.bin", "p/sub/d.bin"):
        store.create(name, b"hello world" if name == "p/b.bin" else b"x")
    with pytest.raises(ExistsError):
        store.create("p/b.bin", b"other")
    assert store.read("p/b.bin") == b"hello world" and store.read_at("p/b.bin", 6, 5) == b"world"
    with pytest.raises(EOFError):
        store.read_at("p/b.bin", 6, 50)
    assert store.list("p/") == ["p/a.bin", "p/b.bin", "p/c.bin", "p/sub/d.bin"] and store.list("none/") == []
    assert [r.length for r in store.files("p").collect()] == [1, 11, 1, 1]
    assert store.calls["create"] == 5 and store.calls["list"] == 2


def test_create_has_one_winner(store):
    won = []

    def run(i):
        try:
            store.create("race/x", str(i).encode())
            won.append(i)
        except ExistsError:
            pass

    threads = [threading.Thread(target=run, args=(i,)) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store.read("race/x") == str(won[0]).encode() and store.list("race/") == ["race/x"]


OPS = [(0, "a", [1.0, 2.0, 3.0, 4.0]), (0, "bb", [5.0, 6.0, 7.0, 8.0])]


def test_log_codec():
    data = binlog.encode(7, OPS)
    assert len(data) == 71 and binlog.decode(data) == (7, OPS)
    assert binlog.decode(binlog.encode(1, [(1, "é", None)])) == (1, [(1, "é", None)])
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(binlog.FormatError):
            binlog.decode(bytes(broken))
    for bad in (b"", data[:-1], data + b"x", data[:40]):
        with pytest.raises(binlog.FormatError):
            binlog.decode(bad)
    with pytest.raises(ValueError):
        binlog.encode(1, [(1, "x" * 65_536, None)])
    with pytest.raises(ValueError):
        binlog.encode(1, [(2, "x", None)])


def test_log_readers(spark, store, tmp_path):
    sources.register(spark)
    for seq in (1, 2, 3):
        store.create(f"wal/{seq:020d}.bin", binlog.encode(seq, [*OPS, (1, f"d{seq}", None)]))
    for read in (lambda a: spark.read.format("oplog").option("after", a).load(str(tmp_path / "wal")), lambda a: binlog.read_oplog(spark, str(tmp_path / "wal"), a)):
        rows = read(1).orderBy("seq", "op_idx").collect()
        assert [(r.seq, r.op_idx, r.op, r.id, r.vector) for r in rows] == [(s, i, o[0], o[1], o[2]) for s in (2, 3) for i, o in enumerate([*OPS, (1, f"d{s}", None)])]
        assert read(9).count() == 0
    assert spark.read.format("oplog").load(str(tmp_path / "wal")).filter("seq > 2").count() == 3
    store.create("wal/00000000000000000009.bin", binlog.encode(4, OPS))
    with pytest.raises(Exception, match="header says 4"):
        spark.read.format("oplog").load(str(tmp_path / "wal")).collect()


def test_vecs(spark, tmp_path):
    sources.register(spark)
    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    vecfiles.write_vecs(str(tmp_path / "x.fvecs"), x)
    vecfiles.write_vecs(str(tmp_path / "x.ivecs"), x.astype(np.int32))
    got = spark.read.format("vecs").option("split", 64).load(str(tmp_path / "x.fvecs")).orderBy("pos").collect()
    assert [(r.pos, r.vector) for r in got] == list(enumerate(x.tolist()))
    got = spark.read.format("vecs").option("element", "int").load(str(tmp_path / "x.ivecs")).orderBy("pos").collect()
    assert [r.vector for r in got] == x.astype(int).tolist()
    (tmp_path / "bad").write_bytes(struct.pack("<i", 3) + b"1234567")
    with pytest.raises(Exception, match="not records"):
        spark.read.format("vecs").load(str(tmp_path / "bad")).collect()


def test_binary_index(store):
    centroids = np.array([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], np.float32)
    clusters = [[("a", np.array([1, 2], np.float32)), ("bé", np.array([3, 4], np.float32))], [], [("c", np.array([5, 6], np.float32))]]
    binindex.write_index(store, "index/x", 12, centroids, clusters)
    index = binindex.BinaryIndex(store, "index/x")
    assert (index.seq, index.k, index.dim) == (12, 3, 2) and np.array_equal(index.centroids, centroids)
    assert [[(n, v.tolist()) for n, v in index.cluster(c)] for c in range(3)] == [[(n, v.tolist()) for n, v in c] for c in clusters]
    head = struct.pack(binindex.HEADER, b"pufi", 0, 1, 2, 3)
    assert binindex.decode_header(head) == (1, 2, 3) and len(head) == 22
    for bad in (head[:21], b"xxxx" + head[4:], head[:4] + b"\1\0" + head[6:]):
        with pytest.raises(binlog.FormatError):
            binindex.decode_header(bad)
    with pytest.raises(binlog.FormatError):
        binindex.decode_cluster(binindex.encode_cluster(clusters[0])[:-1], 2)


def test_json_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "a", "vector": [1, 2], "k": 3}\n{"id": "b"}\n')
    assert [(r.id, r.vector, r.k) for r in json_requests(spark, str(tmp_path)).collect()] == [("a", [1.0, 2.0], 3), ("b", None, None)]


def test_log_writer_and_stream(spark, tmp_path):
    sources.register(spark)
    folder = str(tmp_path / "wal")
    rows = [(s, i, 1 if i == 2 else 0, f"k{i}", None if i == 2 else [1.0 * s, 2.0]) for s in (1, 2, 5) for i in range(3)]
    ops = spark.createDataFrame(rows, OPLOG)
    binlog.write_oplog(ops.repartition(4), folder)
    read = lambda df: sorted(map(repr, df.collect()))
    assert read(spark.read.format("oplog").load(folder)) == read(ops)
    with pytest.raises(Exception, match="(?s)File exists|FileExists"):
        binlog.write_oplog(ops.filter("op_idx = 0"), folder)
    stream = spark.readStream.format("oplog").option("after", 1).load(folder)

    def run():
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    run()
    binlog.write_oplog(spark.createDataFrame([(6, 0, 1, "late", None)], OPLOG), folder)
    run()
    assert sorted((r.seq, r.op_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(s, i) for s in (2, 5) for i in range(3)] + [(6, 0)]


def test_store_delay(spark, tmp_path):
    import time

    slow = Store(spark, str(tmp_path), delay=0.05)
    start = time.perf_counter()
    slow.create("x", b"1")
    assert time.perf_counter() - start >= 0.05 and slow.calls == {"create": 1}
