"""Readers and writers. register(spark) makes the formats `oplog` and `vecs` known to a session."""

from pyspark.sql import SparkSession

from .binlog import OpLogSource
from .vecfiles import VecsSource


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # lets `oplog` skip files by sequence number
    spark.dataSource.register(OpLogSource)
    spark.dataSource.register(VecsSource)
