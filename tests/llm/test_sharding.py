import zlib

from quiverlake.llm import sharding


def brute(rows, shards=40):
    rows = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, seen, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        seen += size
        s = min(shards - 1, (2 * seen - size) * shards // (2 * total))
        out.append((i, size, crc, s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


def compare(spark, rows, **more):
    got = sharding.balanced_shards(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, shard string"), **more)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, **more), key=key)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(spark, rows)
    compare(spark, [(i * 1000, t) for i, t in rows], shards=7)


def test_ids_beyond_doubles(spark):
    rows = [((1 << 62) + 3 * i, f"t{i}") for i in range(200)] + [(i * 0x123456789ABCDE1 % (1 << 63), "h" * i) for i in range(200)] + [(None, "n")]
    compare(spark, rows)


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (2, ""), (None, "é漢"), (None, None), (5, "x" * 100_000), (-4, "y"), (6, "z")])
    compare(spark, [(7, "same")] * 300)
    compare(spark, [(1, "one")])
    assert sharding.balanced_shards(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_id_on_many_rows(spark):
    compare(spark, [(7, "x" * (i % 50)) for i in range(400)] + [(None, f"null {i}") for i in range(300)] + [(i, "y") for i in range(50)])
