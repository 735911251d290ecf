"""Schemas, limits and validation of vectors, operations and results."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Op(IntEnum):
    UPSERT = 0
    DELETE = 1


VECTORS = "id string, vector array<float>"
OPLOG = "seq bigint, op_idx int, op tinyint, id string, vector array<float>"
QUERIES = "query_id bigint, vector array<float>"
RESULTS = "query_id bigint, rank int, id string, score float"
MANIFEST = "version bigint, index string, index_seq bigint, dim int, k int"

#: The binary log keeps an id's length in 16 bits.
MAX_ID_BYTES = 65_535
#: Neighbours that one query may ask for.
MAX_K = 10_000


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    return k


def check_id(name: str) -> str:
    if not name:
        raise ValueError("id is empty")
    if len(name.encode()) > MAX_ID_BYTES:
        raise ValueError(f"id is longer than {MAX_ID_BYTES} bytes")
    return name


def check_vector(vector: list[float], dim: int) -> list[float]:
    if len(vector) != dim:
        raise ValueError(f"the vector has {len(vector)} numbers; {dim} are needed")
    return vector


def split_valid(ops: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Operations that may enter the log, and the rejected ones with a reason."""
    size = F.octet_length("id")
    reason = (
        F.when(F.col("id").isNull() | (size == 0), "empty id")
        .when(size > MAX_ID_BYTES, "id too long")
        .when(F.col("op").isNull() | ~F.col("op").isin(int(Op.UPSERT), int(Op.DELETE)), "unknown operation")
        .when((F.col("op") == int(Op.UPSERT)) & (F.col("vector").isNull() | (F.size("vector") != dim)), "wrong vector length")
    )
    marked = ops.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
