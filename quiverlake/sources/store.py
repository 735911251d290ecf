"""Write-once named files on any filesystem that Hadoop reaches.

Reads and listings go through Spark's Hadoop configuration, so `file:`, `hdfs:` and `s3a:` bases work alike.
Creation never overwrites: exactly one of any number of concurrent creators of a name wins. On a local base that
is an exclusive hard link of a file already written in full, so no reader sees half a file; elsewhere it is the
filesystem's own create-without-overwrite. On an object store that checks only before it writes, so there the write is
asked to be conditional (If-None-Match) as a mandatory option: a connector that cannot do it refuses to create.
"""

from __future__ import annotations

import os
import tempfile
import time
from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Schemes whose create-without-overwrite needs a conditional write, and the connector's option for it.
OBJECT_STORES, CONDITIONAL = ("s3a", "s3", "s3n"), "fs.option.create.conditional.overwrite"


class ExistsError(FileExistsError):
    """The name is taken; what is there was not changed."""


class Store:
    """delay: seconds that every call waits first, to try out a distant store; calls counts them by kind."""

    def __init__(self, spark: SparkSession, base: str, delay: float = 0.0):
        self.spark, self.base, self.delay = spark, base.rstrip("/"), delay
        self.calls: Counter = Counter()

    def _called(self, kind: str) -> None:
        self.calls[kind] += 1
        if self.delay:
            time.sleep(self.delay)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _local(self, name: str) -> str | None:
        url = urlparse(self.path(name))
        return url.path if url.scheme in ("", "file") else None

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def create(self, name: str, data: bytes) -> None:
        self._called("create")
        local = self._local(name)
        if local is None:
            fs, path = self._hadoop(name)
            try:
                new = fs.createFile(path).overwrite(False).recursive()
                if urlparse(self.path(name)).scheme in OBJECT_STORES:
                    new = new.must(CONDITIONAL, True)
                out = new.build()
                out.write(bytearray(data))
                out.close()
            except Exception as e:
                if fs.exists(path):
                    raise ExistsError(name) from e
                raise
            return
        os.makedirs(os.path.dirname(local), exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(local), prefix=".new-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.link(temp, local)
        except FileExistsError:
            raise ExistsError(name) from None
        finally:
            os.unlink(temp)

    def read(self, name: str) -> bytes:
        self._called("read")
        found = self.spark.read.format("binaryFile").load(self.path(name)).select("content").first()
        if found is None:
            raise FileNotFoundError(name)
        return bytes(found.content)

    def read_at(self, name: str, offset: int, length: int) -> bytes:
        """Exactly length bytes; an error if the file ends before."""
        self._called("read_at")
        local = self._local(name)
        if local is not None:
            with open(local, "rb") as f:
                f.seek(offset)
                data = f.read(length)
        else:
            fs, path = self._hadoop(name)
            stream = fs.open(path)
            try:
                stream.seek(offset)
                io = self.spark._jvm.org.apache.commons.io
                data = bytes(io.IOUtils.toByteArray(io.input.BoundedInputStream(stream, length)))  # reads no byte beyond
            finally:
                stream.close()
        if len(data) != length:
            raise EOFError(f"{name}: {length} bytes at {offset} wanted, {len(data)} there")
        return data

    def list(self, prefix: str = "") -> list[str]:
        """Names of all files under a prefix, at any depth, in byte order; empty where there is none."""
        self._called("list")
        root = prefix.rpartition("/")[0]
        fs, path = self._hadoop(root) if root else self._hadoop(".")
        if not fs.exists(path):
            return []
        found, files, top = [], fs.listFiles(path, True), fs.makeQualified(self._hadoop(".")[1]).toString().rstrip("/").removesuffix("/.")
        while files.hasNext():
            name = files.next().getPath().toString().removeprefix(top).lstrip("/")
            if name.startswith(prefix) and not name.rpartition("/")[2].startswith("."):
                found.append(name)
        return sorted(found, key=str.encode)

    def files(self, prefix: str) -> DataFrame:
        """(path, length) of the files under a folder, as a table."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(prefix)).select("path", "length").orderBy("path")


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Files and partitions that the scans of an executed query have read."""
    out: Counter = Counter()

    def walk(node) -> None:
        metrics = node.metrics()
        for name in ("numFiles", "numPartitions") if node.nodeName().startswith("Scan") else ():
            if metrics.contains(name):
                out[name] += metrics.apply(name).value()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return dict(out)


def json_requests(spark: SparkSession, path: str, schema: str = "id string, vector array<float>, k int") -> DataFrame:
    """Requests as JSON lines with a fixed schema."""
    return spark.read.schema(schema).json(path)


def sequence_name(folder: str, seq: int, suffix: str) -> str:
    return f"{folder}/{seq:020d}{suffix}"


def sequence_of(path: str = "path"):
    """The number in a file name of 20 digits, as a column."""
    return F.regexp_extract(F.col(path), r"(\d{20})[^/]*$", 1).cast("bigint")
