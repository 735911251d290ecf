"""What several operators share: checkpoints, the train/held-out fold, hashed numbers, a global order."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def worker_memory() -> dict:
    """A dict that lives as long as the Python process. Package code comes anew with each task, so it cannot hold one."""
    return sys.modules.setdefault("_quiverlake_worker", types.ModuleType("_quiverlake_worker")).__dict__


def fresh(taken: list[str], stem: str) -> str:
    """A column name that is not taken, whatever its case."""
    names = {c.lower() for c in taken}
    name = f"__ql_{stem}"
    while name in names:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a local master (tests, bench) uses its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id written in decimal, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by ':': 52 bits, the same in every engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(2.0**52)


def numbered(df: DataFrame, *order: str, weight: str | None = None) -> tuple[DataFrame, int, int]:
    """(df with `row` and, with a weight, `before`; number of rows; total weight).

    row counts from 0 in the order of the columns, without gaps; before is the weight of all rows ahead. df: a written
    table of narrow rows, read twice. Rows are dealt by ranges of all order columns and sorted there, so only fully
    equal keys need one place. The driver sees one row of totals for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("row", 33).cast("int"))
    size = F.col(weight) if weight else F.lit(0)
    sums = cut(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("heavy")))  # a row for each partition
    n, total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("heavy"), F.lit(0))).first()
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(to) for c, to in (("n", "start"), ("heavy", "ahead"))])
    local = F.col("row").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    out = placed.join(F.broadcast(starts), "part")
    more = []
    if weight:
        run = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
        more = [(F.col("ahead") + F.sum(weight).over(run) - F.col(weight)).alias("before")]
    return out.select(*df.columns, (F.col("start") + local).alias("row"), *more), n, total
