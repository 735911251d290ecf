"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets TREES hash strings of 64 bits, each bit the side of a random hyperplane through the middle of its
chunk. A chunk of vectors is a forest: one sorted array of hash strings for each tree. A query descends in each tree to
the longest prefix that anyone shares with it, then all trees ascend together, one bit at a time, until the prefixes
hold CANDIDATES entries; the vectors found are compared exactly, in double precision.

Chunks come from a coarse hash string of the whole table: as many bits as leave about BUCKET rows in a bucket (none for
a small table), each the side of the median along one main axis of a sample (at most about SAMPLE rows; every row is
indexed). Each bucket is dealt into chunks of about CHUNK rows by its own number of rows, so no group is larger,
however uneven the buckets are. A query goes to the buckets nearest to it, by the distances to the medians that it
would have to cross. How many is measured, not fixed: CALIBRATORS queries are compared with all rows, and enough
buckets are taken to hold `recall` of their true neighbours; recall=1 visits every bucket. Vectors with structure need
few; random directions need most, and the work for a query then grows with the table.

CANDIDATES counts entries over all trees of a chunk, so a vector that several trees find counts several times. The
default is set for vectors without any structure (random directions in 64 dimensions, where the tenth neighbour is
hardly nearer than most), which need most of a chunk for a recall above 0.9; clustered vectors need far fewer.

Cases: equal vectors are one entry with the k + 1 smallest of their ids, which is all that k nearest with ties to the
smaller id can need; a vector that a third of all rows share is one row here. Vectors that are null, zero or hold null
or non-finite components take no part, nor do vectors of another length than most. Rows that repeat both id and vector
count once; of rows that share an id but not the vector, each is an entry. An empty table gives an empty table. Only
the id and vector columns of the input are looked at, so other columns clash with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_unit

TREES, CANDIDATES, CHUNK, BUCKET = 24, 12_000, 8192, 131_072
#: Rows that the coarse bits are fitted on, queries that the number of buckets is measured with, most coarse bits.
SAMPLE, CALIBRATORS, MOST_BITS = 20_000, 64, 16
SEED = 11


def _planes(dim: int, n: int, stream: int) -> np.ndarray:
    return np.random.default_rng([SEED, stream]).standard_normal((dim, n))


def hash_strings(x: np.ndarray, tree: int) -> np.ndarray:
    """64-bit hash strings of the rows; the first bit is the highest."""
    bits = x @ _planes(x.shape[1], 64, tree) > 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


class Coarse:
    """Buckets by medians along main axes: bit j is the side of the j-th median."""

    def __init__(self, sample: np.ndarray, bits: int):
        self.bits = bits
        self.middle = sample.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov(sample - self.middle, rowvar=False, ddof=0).reshape(sample.shape[1], -1))
        axes = axes[:, ::-1][:, :bits]
        more = _planes(sample.shape[1], bits - axes.shape[1], 1 << 20)  # more bits than dimensions
        self.axes = np.hstack([axes, more / np.sqrt((more * more).sum(axis=0))])
        self.medians = np.median((sample - self.middle) @ self.axes, axis=0)

    def sides(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) @ self.axes - self.medians

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return (self.sides(x) > 0) @ (1 << np.arange(self.bits))

    def costs(self, q: np.ndarray) -> np.ndarray:
        """For each query, the squared distance to cross into each bucket, indexed by home bucket XOR bucket."""
        out = np.zeros((len(q), 1))
        for margin in (self.sides(q) ** 2).T:
            out = np.hstack([out, out + margin[:, None]])
        return out

    def nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        costs = self.costs(q)
        flips = np.argpartition(costs, probes - 1, axis=1)[:, :probes] if probes < costs.shape[1] else np.tile(np.arange(costs.shape[1]), (len(q), 1))
        return self.buckets(q)[:, None] ^ flips

    def ranks(self, q: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """How many buckets are nearer to a query than those of its found vectors."""
        costs, home = self.costs(q), self.buckets(q)
        return np.concatenate([(costs[i][None, :] < costs[i][home[i] ^ self.buckets(f)][:, None]).sum(axis=1) for i, f in enumerate(found) if len(f)])


class Forest:
    """Sorted hash strings of a block of vectors, one array for each tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.middle = x.mean(axis=0)
        self.trees = []
        for t in range(trees):
            codes = hash_strings(x - self.middle, t)
            order = np.argsort(codes, kind="stable")
            self.trees.append((codes[order], order))

    def candidates(self, q: np.ndarray, want: int = CANDIDATES) -> list[np.ndarray]:
        """For each query, the rows under the longest prefixes that hold at least want entries over all trees."""
        codes = [hash_strings(q - self.middle, t) for t in range(len(self.trees))]
        low = np.zeros((len(self.trees), len(q)), dtype=np.int64)
        high = np.zeros_like(low)
        open_ = np.arange(len(q))
        for depth in range(64, -1, -1):  # all trees ascend together
            if not len(open_):
                break
            rest = np.uint64((1 << (64 - depth)) - 1)
            for t, (sorted_codes, _) in enumerate(self.trees):
                c = codes[t][open_]
                low[t, open_] = np.searchsorted(sorted_codes, c & ~rest, side="left")
                high[t, open_] = np.searchsorted(sorted_codes, c | rest, side="right")
            open_ = open_[(high - low)[:, open_].sum(axis=0) < want]
        return [np.unique(np.concatenate([order[low[t, i] : high[t, i]] for t, (_, order) in enumerate(self.trees)])) for i in range(len(q))]


def _probes(entries: DataFrame, queries: DataFrame, coarse: Coarse, dim: int, k: int, recall: float) -> int:
    """Buckets that a query must visit to meet the share `recall` of its k nearest, measured on CALIBRATORS queries."""
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATORS).toArrow()
    if not asked.num_rows:
        return 1
    q = matrix(asked.column("v").combine_chunks())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            d = (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)
            best = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : k + 1]
            at, row = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d[at, row]), batch.column("v").take(pa.array(row))], ["q", "d", "v"])

    best = Window.partitionBy("q").orderBy("d")
    found = entries.select("v").mapInArrow(nearest, "q bigint, d double, v array<double>").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).toArrow()
    of = found.column("q").to_numpy()
    x = matrix(found.column("v").combine_chunks())
    ranks = coarse.ranks(q, [x[of == i] for i in range(len(q))])
    return int(np.quantile(ranks, recall, method="higher")) + 1


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`.

    recall: the share of true neighbours that must lie in the buckets visited; 1 visits all of them.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).distinct()
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    spark = embeddings.sparkSession
    if dims is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = dims.d
    rows = rows.filter(F.size("v") == dim)
    # The k + 1 smallest ids of each vector, by a window that drops the rest before the shuffle.
    order = Window.partitionBy("v").orderBy("id")
    entries = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = cut(entries)
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    n = entries.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n) / BUCKET))))
    queries = rows.filter(F.col("id") % every == 0).select("id", "v")
    coarse, probes = None, 1
    if bits:
        some = entries.filter(hash_unit(F.lit("forest"), F.xxhash64("v")) < min(1.0, SAMPLE / n)).select("v").toArrow()
        coarse = Coarse(matrix(some.column("v").combine_chunks()), bits)
        probes = 1 << bits if recall >= 1 else _probes(entries, queries, coarse, dim, k, recall)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = coarse.buckets(matrix(batch.column("v"))) if coarse else np.zeros(batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "bucket"])

    index = entries.mapInArrow(placed, "v array<double>, ids array<bigint>, bucket bigint")
    chunks = np.zeros(1 << bits, dtype=np.int64)
    for r in index.groupBy("bucket").count().collect():  # at most 2 ** MOST_BITS rows
        chunks[r.bucket] = -(-r["count"] // CHUNK)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, deal = (batch.column(c).to_numpy() for c in ("bucket", "deal"))
            chunk = (bucket << 32) + deal % chunks[bucket]
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.nulls(len(chunk), pa.int64()), batch.column("v"), batch.column("ids")], ["chunk", "query", "v", "ids"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                near = coarse.nearest(matrix(part.column("v")), probes) if coarse else np.zeros((part.num_rows, 1), dtype=np.int64)
                to = [[(b << 32) + c for b in row for c in range(chunks[b])] for row in near.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.list_(pa.int64()))], [*part.schema.names, "to"])

    index = index.select("v", "ids", "bucket", F.xxhash64("v").alias("deal")).mapInArrow(dealt, "chunk bigint, query bigint, v array<double>, ids array<bigint>")
    queries = queries.mapInArrow(probed, "id bigint, v array<double>, to array<bigint>")
    queries = queries.select(F.explode("to").alias("chunk"), F.col("id").alias("query"), "v", F.array().cast("array<bigint>").alias("ids"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        asked = table.column("query").is_valid()
        entry, query = table.filter(pa.compute.invert(asked)), table.filter(asked)
        out: list[tuple[int, int, float]] = []
        if len(entry) and len(query):
            x, q = (matrix(t.column("v").combine_chunks()) for t in (entry, query))
            ids, names = entry.column("ids").to_pylist(), query.column("query").to_pylist()
            forest = Forest(x)
            for at in range(0, len(q), 256):
                for i, rows_ in enumerate(forest.candidates(q[at : at + 256]), at):
                    d = np.sqrt(((x[rows_] - q[i]) ** 2).sum(axis=1))
                    if len(d) > k + 1:
                        keep = d <= np.partition(d, k)[k]  # k others besides the query's own entry
                        rows_, d = rows_[keep], d[keep]
                    found = sorted((s, o) for r, s in zip(rows_.tolist(), d.tolist(), strict=True) for o in ids[r] if o != names[i])[:k]
                    out += [(names[i], o, s) for s, o in found]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = index.unionByName(queries).groupBy("chunk").applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
