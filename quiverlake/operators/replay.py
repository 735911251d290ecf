"""Last-write-wins replay of an operation log.

The log has (seq, op_idx, op, id, vector); operations are totally ordered by (seq, op_idx). Upserts of another
length than dim are left out first, as if they were not in the log: they neither change an id nor touch it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Op


def accepted(log: DataFrame, dim: int | None = None, after: int = 0) -> DataFrame:
    """Operations with seq > after that count: known kinds, and upserts of the right length."""
    known = F.col("op") == int(Op.DELETE)
    upsert = F.col("op") == int(Op.UPSERT)
    if dim is not None:
        upsert = upsert & (F.size("vector") == dim)
    return log.filter((F.col("seq") > after) & (known | upsert))


def snapshot(log: DataFrame, dim: int | None = None, after: int = 0) -> DataFrame:
    """(id, vector) of the ids that are alive after the log: one map-side combined aggregation by id."""
    last = F.max_by(F.struct("op", "vector"), F.struct("seq", "op_idx")).alias("last")
    return accepted(log, dim, after).groupBy("id").agg(last).filter(F.col("last.op") == int(Op.UPSERT)).select("id", F.col("last.vector").alias("vector"))


def touched(log: DataFrame, dim: int | None = None, after: int = 0) -> DataFrame:
    """Ids with any accepted operation after `after`, deletes too."""
    return accepted(log, dim, after).select("id").distinct()


def max_seq(log: DataFrame) -> DataFrame:
    """One row: the last sequence number, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("bigint")).alias("max_seq"))


def live_count(log: DataFrame, dim: int | None = None) -> DataFrame:
    return snapshot(log, dim).agg(F.count(F.lit(1)).alias("live"))


def merge_snapshot(base: DataFrame, log: DataFrame, dim: int | None, after: int) -> DataFrame:
    """A base snapshot that covers seq <= after, brought up to date by the rest of the log."""
    return base.join(touched(log, dim, after), "id", "left_anti").unionByName(snapshot(log, dim, after))


def latest(log: DataFrame, dim: int | None = None) -> DataFrame:
    """The last accepted operation of each id, deletes too: a shorter log with the same snapshot and touched ids."""
    last = F.max_by(F.struct("op", "vector"), F.struct("seq", "op_idx")).alias("last")
    at = F.max(F.struct("seq", "op_idx")).alias("at")
    found = accepted(log, dim).groupBy("id").agg(last, at)
    return found.select("at.seq", "at.op_idx", "last.op", "id", "last.vector")
