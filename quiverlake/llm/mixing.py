"""Mixing sources to target weights by Poisson replication.

A source with target weight w holds, after mixing, about w of the budget of characters. Its mean repetition
rate is w * budget / size; every document of it is repeated k times, k drawn from the Poisson distribution
with that mean by inverting its distribution function at a number hashed from (seed, doc_id). The draw of a
document does not depend on the other rows or on partitioning, so a rerun or a lost executor gives the same
corpus. A rate above MAX_PART is drawn as a sum of equal independent parts, which keeps every table of
probabilities short and exp() from underflowing. The copies are then put in one global random order.

Only DataFrame functions. Edge cases: a null source is a source of its own; a null or empty text counts one
character; rows with the same doc_id draw the same number; a source without a target (when targets are given)
or with weight 0 goes; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, hash_unit

#: Poisson means up to this are inverted in one step.
MAX_PART = 64.0
#: Sources up to this many are broadcast, about 1 KB each; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def _size(text: str) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None) -> DataFrame:
    """(src, chars, rate): the mean repetitions of each source.

    targets: weight of each source (normalised); None: weights proportional to size ** alpha.
    budget: characters of the mixed corpus; None: as many as the input has.
    """
    sizes = docs.groupBy(F.col("source").alias("src")).agg(F.sum(_size("text")).alias("chars"))
    if targets is None:
        sizes = sizes.withColumn("w", F.pow(F.col("chars").cast("double"), F.lit(float(alpha))))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        sizes = sizes.withColumn("w", weight)
    sizes = cut(sizes)  # one row a source; the texts are read once for it
    all_w, all_chars = sizes.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    want = float(all_chars if budget is None else budget)
    return sizes.select("src", "chars", F.coalesce(F.try_divide(F.col("w") * F.lit(want), F.lit(all_w) * F.col("chars")), F.lit(0.0)).alias("rate"))


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is far below 2 ** -53."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(mean) - F.ln(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    first = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["cdf"])


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None, seed: int = 17, shuffle: bool = True, copy_col: str = "copy_no", key_col: str = "mix_key") -> DataFrame:
    """docs with every row repeated by its draw, plus copy_col (from 0) and key_col (the hashed global order).

    With shuffle, rows are range-partitioned and sorted by key_col, so part files read in order are one
    uniformly shuffled corpus. Input columns named like the two new ones are replaced.
    """
    docs = docs.drop(copy_col, key_col)
    src, parts_, cdf, n = (fresh([*docs.columns, copy_col, key_col], x) for x in ("src", "parts", "cdf", "n"))
    rates = source_rates(docs, targets, alpha, budget)
    parts = F.ceil(F.col("rate") / MAX_PART).cast("int")
    tables = rates.filter("rate > 0").select(F.col("src").alias(src), parts.alias(parts_), poisson_table(F.col("rate") / parts).alias(cdf))
    if tables.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    draw = lambda i: F.size(F.filter(F.col(cdf), lambda c: c < hash_unit(F.lit(seed), docs["doc_id"], i)))
    count = F.aggregate(F.sequence(F.lit(1), F.col(parts_)), F.lit(0), lambda acc, i: acc + draw(i))
    out = docs.join(tables, docs["source"].eqNullSafe(F.col(src))).withColumn(n, count).filter(F.col(n) > 0)
    out = out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_col))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy_col).cast("string")).cast("binary"))
    out = out.withColumn(key_col, F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint"))
    return out.repartitionByRange(F.col(key_col)).sortWithinPartitions(key_col, "doc_id", copy_col) if shuffle else out


def oracle(alpha: float = 0.7, seed: int = 17) -> str:
    """DuckDB SQL for the query's rows."""
    return f"""
WITH s AS (SELECT source AS src, sum(coalesce(length(text), 0) + 1)::DOUBLE AS chars FROM documents GROUP BY 1),
r AS (SELECT src, pow(chars, {alpha}) * (SELECT sum(chars) FROM s) / ((SELECT sum(pow(chars, {alpha})) FROM s) * chars) AS rate FROM s),
p AS (SELECT src, rate, ceil(rate / {MAX_PART})::INT AS parts FROM r),
k AS (SELECT src, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM p, range(0, {math.ceil(MAX_PART + 12 * math.sqrt(MAX_PART) + 41)}) t(k)),
c AS (SELECT src, parts, list(cdf ORDER BY k) AS cdf FROM (SELECT src, parts, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM k) GROUP BY 1, 2),
d AS (SELECT doc_id, source, cdf, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM documents JOIN c ON source IS NOT DISTINCT FROM src, LATERAL (SELECT unnest(range(1, parts + 1)) AS i)),
n AS (SELECT doc_id, source, sum(len(list_filter(cdf, lambda x: x < u))) AS n FROM d GROUP BY 1, 2),
e AS (SELECT doc_id, source, unnest(range(0, n::BIGINT))::INT AS copy_no FROM n WHERE n > 0)
SELECT doc_id, source, copy_no, ('0x' || substr(md5('order{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 15))::BIGINT AS mix_key FROM e
"""
