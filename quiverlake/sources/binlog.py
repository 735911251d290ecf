"""The binary operation log: codec, batch reader with file skipping, and writer.

One file is one batch; its name is its sequence number in 20 digits. All checks come before the data is trusted:
length, magic, version, checksum, then the operations, and the number in the header must be the one in the name.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

from ..schema import OPLOG, Op, check_id

# Fixed values of the file format: magic, version, then little-endian fields.
MAGIC, VERSION = b"puff", 0
HEADER = "<4sHQI"  # magic, version, sequence, operations
CHECKSUM = "<I"  # CRC-32 (IEEE) of all bytes before it
OPERATION = "<BH"  # kind, bytes of the id
LENGTH = "<I"  # numbers in the vector
HEADER_SIZE, CHECKSUM_SIZE, OPERATION_SIZE = map(struct.calcsize, (HEADER, CHECKSUM, OPERATION))

Operation = tuple[int, str, list[float] | None]


class FormatError(ValueError):
    """The bytes are not a valid file."""


def encode(seq: int, ops: list[Operation]) -> bytes:
    out = [struct.pack(HEADER, MAGIC, VERSION, seq, len(ops))]
    for kind, name, vector in ops:
        raw = check_id(name).encode()
        out += [struct.pack(OPERATION, Op(kind), len(raw)), raw]
        if kind == Op.UPSERT:
            out += [struct.pack(LENGTH, len(vector)), struct.pack(f"<{len(vector)}f", *vector)]
    body = b"".join(out)
    return body + struct.pack(CHECKSUM, zlib.crc32(body))


def decode(data: bytes) -> tuple[int, list[Operation]]:
    if len(data) < HEADER_SIZE + CHECKSUM_SIZE:
        raise FormatError("too short")
    magic, version, seq, count = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise FormatError("bad magic")
    if version != VERSION:
        raise FormatError(f"unsupported version {version}")
    body = memoryview(data)[: -CHECKSUM_SIZE]
    if struct.unpack_from(CHECKSUM, data, len(body))[0] != zlib.crc32(body):
        raise FormatError("checksum mismatch")
    ops: list[Operation] = []
    at = HEADER_SIZE

    def take(n: int) -> memoryview:
        nonlocal at
        if at + n > len(body):
            raise FormatError("truncated operation")
        at += n
        return body[at - n : at]

    for _ in range(count):
        kind, size = struct.unpack(OPERATION, take(OPERATION_SIZE))
        if kind not in (Op.UPSERT, Op.DELETE):
            raise FormatError(f"unknown operation {kind}")
        name = bytes(take(size)).decode()
        vector = None
        if kind == Op.UPSERT:
            n = struct.unpack(LENGTH, take(4))[0]
            vector = list(struct.unpack(f"<{n}f", take(4 * n)))
        ops.append((kind, name, vector))
    if at != len(body):
        raise FormatError("bytes after the last operation")
    return seq, ops


def as_batch(seq: int, ops: list[Operation]) -> pa.RecordBatch:
    columns = [pa.array([seq] * len(ops), pa.int64()), pa.array(range(len(ops)), pa.int32()), pa.array([o[0] for o in ops], pa.int8()), pa.array([o[1] for o in ops], pa.string()), pa.array([o[2] for o in ops], pa.list_(pa.float32()))]
    return pa.RecordBatch.from_arrays(columns, ["seq", "op_idx", "op", "id", "vector"])


def read_oplog(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """The log in any store that Spark reads: files numbered up to `after` are pruned by name, unread."""
    name = F.col("_metadata.file_name")
    files = spark.read.format("binaryFile").load(folder).filter(name > f"{after:020d}.bin").select(name.alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                seq, ops = decode(content.as_py())
                if seq != sequence_in(file):
                    raise FormatError(f"{file}: the header says {seq}")
                yield as_batch(seq, ops)

    return files.mapInArrow(run, OPLOG)


def sequence_in(name: str) -> int:
    found = re.fullmatch(r"(\d{20})\.bin", os.path.basename(name))
    if not found:
        raise FormatError(f"not a log file: {name}")
    return int(found[1])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class OpLogSource(DataSource):
    """The format `oplog` over a folder: batch reads, streams and writes.

    Reading makes one partition of each file; option `after` skips files unread. A stream starts after `after` and
    takes the files that have come since. write_oplog() writes.
    """

    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> str:
        return OPLOG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self.options["path"].removeprefix("file:"))


def _numbered(folder: str, after: int, upto: int | None = None) -> list[str]:
    """Paths of the log files with after < number <= upto, in order."""
    names = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_"))) if os.path.isdir(folder) else []
    return [os.path.join(folder, n) for n in names if sequence_in(n) > after and (upto is None or sequence_in(n) <= upto)]


def _read_file(path: str) -> Iterator[pa.RecordBatch]:
    if path:
        with open(path, "rb") as f:
            seq, ops = decode(f.read())
        if seq != sequence_in(path):
            raise FormatError(f"{path}: the header says {seq}")
        yield as_batch(seq, ops)


class _Reader(DataSourceReader):
    """Filters on seq prune files by name; everything else is left to Spark."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file:")
        self.after = int(options.get("after", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and isinstance(f.value, int):
                self.after = max(self.after, f.value - (not isinstance(f, GreaterThan)))
            yield f  # rows are still filtered by Spark

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _numbered(self.folder, self.after)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read_file(partition.path)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.after = options["path"].removeprefix("file:"), int(options.get("after", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        names = _numbered(self.folder, self.after)
        return {"seq": sequence_in(names[-1]) if names else self.after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for p in _numbered(self.folder, start["seq"], end["seq"])] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read_file(partition.path)


class _Writer(DataSourceWriter):
    """Rows of one number must come to one task in order; a number that exists is an error."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for seq, group in itertools.groupby(rows, key=lambda r: r.seq):
            data = encode(seq, [(r.op, r.id, r.vector) for r in group])
            final = os.path.join(self.folder, f"{seq:020d}.bin")
            try:
                with open(final, "xb") as f:
                    f.write(data)
            except FileExistsError:
                with open(final, "rb") as f:
                    if f.read() != data:  # a repeated task finds its own file
                        raise
        return WriterCommitMessage()


def write_oplog(ops: DataFrame, folder: str) -> None:
    """Append (seq, op_idx, op, id, vector) to a log folder, one file for each seq."""
    rows = ops.select("seq", "op_idx", "op", "id", "vector").repartition("seq").sortWithinPartitions("seq", "op_idx")
    rows.write.format("oplog").mode("append").save(folder)
