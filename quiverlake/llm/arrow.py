"""Small pieces of Arrow batches, so a Python worker holds a few texts at a time however many a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of text that a worker unpacks at once; a longer single text is unpacked alone.
ROWS, BYTES = 256, 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(ROWS, batch.num_rows - at)
            while n > 1 and batch.column(column).slice(at, n).nbytes > BYTES:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def filtered(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, whose text `keep` marks True; rows are passed through once, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(keep(part.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
