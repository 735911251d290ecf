"""The live snapshot as keyed stream state: last write wins by id, deletes forget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import Op


def live_updates(ops: DataFrame) -> DataFrame:
    """(id, seq, op_idx, alive) after each micro-batch for the ids it touched; ops is a stream of log rows."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (0, -1, False)
        for rows in batches:
            for seq, at, op in zip(rows.seq, rows.op_idx, rows.op, strict=True):
                last = max(last, (int(seq), int(at), op == Op.UPSERT), key=lambda x: x[:2])
        state.update(last)
        yield pd.DataFrame({"id": [key[0]], "seq": [last[0]], "op_idx": [last[1]], "alive": [last[2]]})

    return ops.select("id", "seq", "op_idx", "op").groupBy("id").applyInPandasWithState(fold, "id string, seq bigint, op_idx int, alive boolean", "seq bigint, op_idx int, alive boolean", "update", GroupStateTimeout.NoTimeout)
