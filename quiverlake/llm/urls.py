"""URL filter: rules by host and path prefix, and gradient-boosted trees over lexical features for the rest.

A rule is (host, path prefix, verdict). It fits its host and every subdomain when the path starts with its
prefix; the longest host + path that fits wins. URLs that a rule judges are the labelled ones: on a bounded sample
of them (about MAX_TRAINING, by a hash of the URL) boosted trees learn to tell block from allow by length, path
depth, digit ratio, character entropy, parameter counts and the block rates of the host's last one and two
labels, of all suffixes in the sample (a table of at most its rows, broadcast). The trees become nested CASE
expressions, so scoring runs in the JVM on every row, without a shuffle.

Host and path as in the query: the host follows the first '://' up to '/', '?', '#' or the end, with A-Z
lower-cased; the path follows up to '?', '#' or the end.

Cases: a null URL, or one without '://', has both empty; it is judged by the trees like any other. Very long URLs are
read whole. Of rules of equal length the later in the list wins; of equal splits the trees take the first feature and
the lowest value. Without labelled URLs, or with labels of one kind, the trees say that kind (allow where there is
none). Repeated rows are judged alike; an empty table gives an empty table. Only page_id and url of the input are
looked at, so other columns clash with nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_unit

MAX_TRAINING = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 24, 3, 0.3, 32, 20, 1.0
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix1", "suffix2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
#: The rules of the registered query: host, path prefix, verdict.
RULES: tuple[Rule, ...] = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The winning rule as host + path, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _suffix(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def entropy_of(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no labels, all doubles."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    count = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    return {
        "length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"), "labels": count(host, "."), "depth": count(path, "/"),
        "digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)).cast("double"), "entropy": entropy_of(text),
        "parameters": F.when(query == "", 0.0).otherwise(1 + count(query, "&")), "hyphens": count(text, "-"),
    }


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        self.bias = math.log((share + 1e-3) / (1 - share + 1e-3))
        self.trees: list = []
        if not 0 < share < 1:
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)])
        f = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(bins, weight * (y - p), weight * p * (1 - p), weight, np.arange(len(y)), DEPTH, np.zeros(len(y)))
            self.trees.append(tree)
            f += step

    def _grow(self, bins, g, h, w, rows, depth, out):
        best = (1e-6, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + L2)
        for j in range(bins.shape[1]) if depth else ():
            n = len(self.edges[j]) + 1
            gs, hs, ws = (np.cumsum(np.bincount(bins[rows, j], weights=v[rows], minlength=n))[:-1] for v in (g, h, w))
            right = ws[-1] if len(ws) else 0
            gain = gs**2 / (hs + L2) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + L2) - total
            gain[(ws < LEAST_LEAF) | (w[rows].sum() - ws < LEAST_LEAF)] = 0
            if right and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            value = RATE * g[rows].sum() / (h[rows].sum() + L2)
            out[rows] = value
            return float(value), out
        _, j, b = best
        low = bins[rows, j] <= b
        left, _ = self._grow(bins, g, h, w, rows[low], depth - 1, out)
        right, _ = self._grow(bins, g, h, w, rows[~low], depth - 1, out)
        return (j, float(self.edges[j][b]), left, right), out

    def column(self, features: list[Column]) -> Column:
        def of(node) -> Column:
            return F.lit(node) if isinstance(node, float) else F.when(features[node[0]] < node[1], of(node[2])).otherwise(of(node[3]))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + of(tree)
        return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_training: int = MAX_TRAINING) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' block probability."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), url.alias("url")).select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = rows.select("*", _suffix(F.col("host"), 1).alias("s1"), _suffix(F.col("host"), 2).alias("s2"))
    labelled = rows.filter("ruled IS NOT NULL").select("url", "host", "path", "s1", "s2", (F.col("ruled") == "block").cast("int").alias("bad"))
    n, = labelled.agg(F.count(F.lit(1))).first()
    sample = labelled.filter(hash_unit(F.lit("urls"), F.col("url")) < min(1.0, max_training / max(1, n)))
    # Repeated URLs come as one weighted row, so this is about max_training rows at most.
    sample = sample.groupBy("url", "host", "path", "s1", "s2", "bad").agg(F.count(F.lit(1)).alias("n")).select("s1", "s2", "bad", "n", *[c.alias(f"f_{k}") for k, c in features.items()])
    sample = cut(sample)
    bad, all_ = sample.agg(F.coalesce(F.sum(F.col("n") * F.col("bad")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    prior = bad / max(1, all_)
    rate = (F.sum(F.col("n") * F.col("bad")) + 5 * prior) / (F.sum("n") + 5)
    tables = {s: sample.groupBy(s).agg(rate.alias(f"r{s}")) for s in ("s1", "s2")}  # every suffix of the sample

    def with_suffixes(df: DataFrame) -> DataFrame:
        for s, table in tables.items():
            df = df.join(F.broadcast(table), s, "left")
        first = F.coalesce("rs1", F.lit(prior))
        return df.withColumns({"f_suffix1": first, "f_suffix2": F.coalesce(F.col("rs2"), first)})

    got = with_suffixes(sample).select("bad", "n", *[f"f_{k}" for k in FEATURES]).collect()
    x = np.array([[r[f"f_{k}"] for k in FEATURES] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    model = Trees(x, np.array([r.bad for r in got], dtype=float), np.array([r.n for r in got], dtype=float))
    rows = with_suffixes(rows.select("*", *[c.alias(f"f_{k}") for k, c in features.items()]))
    raw = model.column([F.col(f"f_{k}") for k in FEATURES]) if len(got) else F.lit(-10.0)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-raw)))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
