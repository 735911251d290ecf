"""fvecs and ivecs files (S9-S11): records of a 32-bit length and as many 32-bit numbers, all of one length.

spark.read.format("vecs").option("element", "float" or "int").load(file) gives (pos, vector). The file is cut at
record borders into partitions of SPLIT bytes; its size must be a whole number of records.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binlog import FormatError

SPLIT = 32 << 20


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _element(self) -> str:
        element = self.options.get("element", "float")
        if element not in ("float", "int"):
            raise ValueError("element must be float or int")
        return element

    def schema(self) -> str:
        return f"pos bigint, vector array<{self._element()}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file:"), self._element(), int(self.options.get("split", SPLIT)))


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, element: str, split: int):
        self.path, self.element = path, element
        size = os.path.getsize(path)
        self.dim = int(np.fromfile(path, "<i4", 1)[0]) if size >= 4 else 0
        self.record = 4 + 4 * self.dim
        if size and (self.dim <= 0 or size % self.record):
            raise FormatError(f"{path}: {size} bytes are not records of {self.dim} numbers")
        self.n, self.step = size // self.record if size else 0, max(1, split // self.record)

    def partitions(self) -> list[InputPartition]:
        return [_Range(at, min(self.step, self.n - at)) for at in range(0, self.n, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        raw = np.fromfile(self.path, "<i4", partition.count * (self.dim + 1), offset=partition.first * self.record).reshape(-1, self.dim + 1)
        if (raw[:, 0] != self.dim).any():
            raise FormatError(f"{self.path}: records differ in length")
        body = np.ascontiguousarray(raw[:, 1:])
        kind = pa.float32() if self.element == "float" else pa.int32()
        values = pa.array(body.ravel().view("<f4") if self.element == "float" else body.ravel(), kind)
        offsets = pa.array(np.arange(len(body) + 1, dtype=np.int32) * self.dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + len(body))), pa.ListArray.from_arrays(offsets, values)], ["pos", "vector"])


def write_vecs(path: str, rows: np.ndarray) -> None:
    """A file of equal rows of float32 or int32."""
    rows = np.asarray(rows)
    kind = "<f4" if rows.dtype.kind == "f" else "<i4"
    out = np.empty((rows.shape[0], rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = rows.astype(kind).view("<i4")
    out.tofile(path)
