"""Contiguous, byte-balanced shards from global prefix sums.

Documents are put in the order (doc_id, size, checksum), null ids first, by ranges of all three: rows of one id are
split by the others, fully equal rows by the order in which they were read. Each range's total of bytes and rows is
one row of a small table; its running totals give every range the bytes and rows before it, and a window inside the
range gives the rest. A document belongs to the shard in which the middle of its bytes falls when the total is cut at
equal targets, so a shard differs from the target by less than the largest document.

Cases: a null text has no bytes and checksum 0; a very long text is one row of its size; ties go by size and checksum,
and fully equal rows are interchangeable; an empty table gives an empty table; with fewer documents than shards some
shards stay empty. Only doc_id and text of the input are looked at, so other columns clash with nothing. No text is
moved: only ids, sizes and checksums are written to the checkpoint folder and shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def balanced_shards(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts from 0 within a shard, without gaps."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(raw) + overhead).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("read"))
    placed, _, total = numbered(cut(rows.withColumn("known", F.col("doc_id").isNotNull())), "known", "doc_id", "size", "text_crc32", "read", weight="size")
    middle = (F.col("before").cast("decimal(30,0)") * 2 + F.col("size")) * shards / F.lit(max(1, 2 * total)).cast("decimal(30,0)")
    placed = cut(placed.select("doc_id", "size", "text_crc32", F.least(F.floor(middle), F.lit(shards - 1)).cast("int").alias("shard"), "row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
