"""Distances between vectors as Column expressions, and the same in numpy for large batches.

All sums run in float32, one dimension after the other, so that every form gives the same bits. Cosine divides in
double and is narrowed to float32; it is null where a vector is zero, and null sorts last.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import IntEnum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(IntEnum):
    COSINE = 0
    L2 = 1
    DOT = 2


#: Metrics for which a larger score is nearer.
DESCENDING = frozenset({Metric.COSINE, Metric.DOT})


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0).cast("float"), lambda s, x: s + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    """value where the lengths agree; an error where they do not, never a null score."""
    problem = F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), value).otherwise(problem.cast("float"))


def l2_squared(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)))


def dot_product(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(a, b, lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: _fold(x, y, lambda p, q: p * q).cast("double")
    return _same_length(a, b, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).cast("float"))


_COLUMNS = {Metric.L2: l2_squared, Metric.DOT: dot_product, Metric.COSINE: cosine_similarity}


def score(metric: Metric | str, a: Column, b: Column) -> Column:
    """The score column of a metric, by enum or name."""
    return _COLUMNS[as_metric(metric)](a, b)


def as_metric(metric: Metric | str) -> Metric:
    if isinstance(metric, Metric):
        return metric
    try:
        return Metric[str(metric).upper()]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}") from None


def best_first(metric: Metric | str, score_col: str = "score") -> Column:
    return F.col(score_col).desc_nulls_last() if as_metric(metric) in DESCENDING else F.col(score_col).asc_nulls_last()


def score_matrix(metric: Metric | str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """float32 scores, queries by vectors; the same bits as the Column forms. NaN where cosine is undefined."""
    metric = as_metric(metric)
    q, x = np.asarray(queries, np.float32), np.asarray(vectors, np.float32)
    if q.shape[1] != x.shape[1]:
        raise ValueError(f"vector lengths differ: {q.shape[1]} and {x.shape[1]}")
    out = np.zeros((len(q), len(x)), np.float32)
    columns = np.ascontiguousarray(x.T)
    for j in range(q.shape[1]):
        if metric is Metric.L2:
            d = q[:, j, None] - columns[j]
            out += d * d
        else:
            out += q[:, j, None] * columns[j]
    if metric is Metric.COSINE:
        norm = lambda m: np.sqrt(_squares(m).astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (out.astype(np.float64) / (norm(q)[:, None] * norm(x))).astype(np.float32)
    return out


def _squares(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m), np.float32)
    for j in range(m.shape[1]):
        out += m[:, j] * m[:, j]
    return out
