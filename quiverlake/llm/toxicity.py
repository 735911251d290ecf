"""Toxicity scores from the nearest labelled examples.

Terms are words and word beginnings of 4 and 6 letters. On a bounded sample of labelled documents (about MAX_PER_LABEL
of each label, by a hash of the id) every term of two documents or more gets its idf, times c / (c + 2 ln V): c is the
chi-squared of term and label in the sample, V the number of terms, 2 ln V about what chance gives the best of V
terms. So every term counts, for or against the label, and those that say nothing count little: with plain idf the few
words that matter vanish in the norm of a long text (F1 of the label on held-out rows of sf0.1: 0.95 against 0.74).
Every sampled document becomes a unit TF-IDF vector. The examples live in an inverted index whose postings are cut
into blocks of BLOCK examples, like ones side by side, with the largest weight of each term in each block (terms that
are everywhere have full rows). A query
adds up block bounds, visits blocks from the highest bound down, scores their examples exactly from the postings of
those blocks alone, and stops when no bound can reach the k-th best: the exact k nearest by cosine, ties to the smaller
example number. Their labels vote with the cosine as weight, times what a sampled row of its label stands for;
leave-one-out votes of the examples (computed on executors) are fitted by isotonic regression, which turns a vote into
a calibrated score. The neighbours are returned as evidence.

Scoring reads whole texts of all documents and nothing else.

Cases: a text without a known term (also null or empty) gets the rate of such examples and no evidence. Very long
texts are read whole; a word longer than LONGEST is known by its beginnings alone. Repeated rows are scored alike. Of
a labelled id with several texts the first in order is learned from, of an id with several labels the highest.
Without labelled rows every score is 0; an empty table gives an empty table. Working columns are chosen from doc_id,
text and the labels' columns alone, so other columns clash with nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import filtered, slices
from .common import cut, hash_unit, is_held_out

#: Expected number of learned rows of each label; examples of a block; neighbours that vote.
MAX_PER_LABEL, BLOCK, NEIGHBOURS = 1000, 32, 15
#: A term of this share of the examples (one in FULL) or more has a full row of weights.
FULL = 16
PREFIXES, LONGEST = (4, 6), 64
THRESHOLD = 0.3
CACHE = 1 << 18
_WORD = re.compile(r"\w+")

#: Sorted term numbers of a text and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def features_of(word: str) -> list[str]:
    """A word's beginnings, and the word itself unless it is longer than any word is."""
    return [*([word] if len(word) <= LONGEST else []), *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Vocabulary:
    def __init__(self, weights: dict[str, float]):
        self.numbers = {f: i for i, f in enumerate(sorted(weights))}
        self.weights = np.array([weights[f] for f in sorted(weights)])
        self._words: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        known = self._words.get(word)
        if known is None:
            known = tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)
            if len(word) <= LONGEST:
                self._words[word] = known
        return known

    def counts(self, text: str | None) -> Counts:
        if len(self._words) >= CACHE:
            self._words.clear()
        seen: dict[int, int] = {}
        for word, n in Counter(_WORD.findall(text.lower()) if text else ()).items():
            for i in self._of(word):
                seen[i] = seen.get(i, 0) + n
        at = np.fromiter(seen.keys(), np.int64, len(seen))
        n = np.fromiter(seen.values(), np.int64, len(seen))
        order = np.argsort(at)
        return at[order], n[order]

    def vector(self, counts: Counts) -> Counts:
        at, n = counts
        w = (1 + np.log(n)) * self.weights[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm > 0 else w

    def __getstate__(self):
        return self.numbers, self.weights

    def __setstate__(self, state):
        self.numbers, self.weights = state
        self._words = {}


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes)
    return np.repeat(starts - before + sizes, sizes) + np.arange(before[-1])


class BlockMaxIndex:
    """Exact cosine top k over sparse unit vectors. `touched` counts the postings that searches have read.

    Terms of a FULL-th of the examples or more have a row of weights over all examples instead of postings: what they
    give is computed for every example at once, and its largest value in each block is part of the block's bound.
    """

    def __init__(self, vectors: list[Counts], n_terms: int, block: int = BLOCK, full: int = FULL):
        self.n, self.block, self.blocks, self.touched = len(vectors), block, -(-len(vectors) // block), 0
        sizes = [len(at) for at, _ in vectors]
        doc = np.repeat(np.arange(self.n), sizes)
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) * full >= max(self.n, 2 * full))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n))
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        # One entry for each term and block: where its postings start and end, and the largest weight.
        key = term[order] * max(1, self.blocks) + self.doc // block
        first = np.flatnonzero(np.diff(key, prepend=-1)).astype(np.int32)
        self.start, self.end = first, np.append(first[1:], len(key)).astype(np.int32)[: len(first)]
        self.block_of = (key[first] % max(1, self.blocks)).astype(np.int32)
        self.peak = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(key[first] // max(1, self.blocks), np.arange(n_terms + 1)).astype(np.int32)

    def given(self, vectors: list[Counts]) -> np.ndarray:
        """What the terms with full rows give to each example, one row for each of the vectors: one matrix product."""
        q = np.zeros((len(vectors), len(self.rows)))
        for i, (at, w) in enumerate(vectors):
            row = self.row[at]
            q[i, row[row >= 0]] = w[row >= 0]
        return q @ self.rows

    def top(self, at: np.ndarray, w: np.ndarray, k: int, given: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k examples of the largest positive cosine, as (-cosine, number), in order."""
        if given is None:
            given = self.given([(at, w)])[0]
        often = self.row[at] >= 0
        at, w = at[~often], w[~often]
        low, high = self.entries[at], self.entries[at + 1]
        entry, q = _spans(low, high), np.repeat(w, high - low)
        block = self.block_of[entry]
        bound = np.bincount(block, q * self.peak[entry], self.blocks) + np.maximum.reduceat(given, np.arange(0, self.n, self.block))
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        done, step = 0, 4
        while done < self.blocks and bound[order[done]] > 0:
            if len(best) >= k and bound[order[done]] < -best[k - 1][0] - 1e-9:
                break
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[order[done : done + step]] = True
            mine = chosen[block]
            start, end = self.start[entry[mine]], self.end[entry[mine]]
            posting = _spans(start, end)
            self.touched += len(posting)
            score = np.bincount(self.doc[posting], np.repeat(q[mine], end - start) * self.weight[posting], self.n)
            score = np.where(np.repeat(chosen, self.block)[: self.n], score + given, 0.0)
            hit = np.flatnonzero(score > 0)
            if len(hit) > k:  # ties at the k-th place stay, the smaller numbers win below
                cut_at = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                hit = hit[score[hit] >= cut_at - 1e-11]
                hit = hit[np.lexsort((hit, -np.round(score[hit], 12)))[:k]]
            best = sorted([*best, *zip((-np.round(score[hit], 12)).tolist(), hit.tolist(), strict=True)])[:k]
            done, step = done + step, step * 4
        return best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y by x with weights w (pool adjacent violators)."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, weights=w)
    pools: list[list[float]] = []
    for m, w, at in zip(np.bincount(inverse, weights=w * y) / weight, weight, xs, strict=True):
        pools.append([m, w, at, at])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([v for p in pools for v in (p[0], p[0])])


class Model:
    """Examples (id, label, counts), what a row of each label stands for, and the calibration once it is fitted."""

    def __init__(self, vocabulary: Vocabulary, examples: list[tuple[int, int, Counts]], stands_for: dict[int, float], k: int = NEIGHBOURS):
        self.vocabulary, self.k, self.knots = vocabulary, k, None
        vectors = [(i, y, vocabulary.vector(c)) for i, y, c in examples]
        # Like vectors share blocks: order by the heaviest terms.
        vectors.sort(key=lambda r: (r[2][0][np.argsort(-r[2][1], kind="stable")[:3]].tolist(), r[0]))
        full = [r for r in vectors if r[2][1].any()]
        mass = lambda rows: (sum(stands_for[y] * y for _, y, _ in rows), sum(stands_for[y] for _, y, _ in rows))
        bad, all_ = mass(vectors)
        self.rate = (bad + 0.5) / (all_ + 1) if vectors else 0.0
        bad, all_ = mass([r for r in vectors if not r[2][1].any()])
        self.empty_rate = (bad + self.rate) / (all_ + 1)
        self.ids, self.labels = [r[0] for r in full], np.array([r[1] for r in full], dtype=float)
        self.stands_for = np.array([stands_for[r[1]] for r in full], dtype=float)
        self.index = BlockMaxIndex([r[2] for r in full], len(vocabulary.numbers))
        self._seen: dict = {}

    def near(self, counts: list[Counts], leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The k nearest examples of each as (-cosine, number), without the example of the id to leave out."""
        keys = [(at.tobytes(), n.tobytes()) for at, n in counts]
        if len(self._seen) >= CACHE >> 6:
            self._seen.clear()
        fresh = {key: self.vocabulary.vector(c) for key, c in zip(keys, counts, strict=True) if key not in self._seen}
        for (key, (at, w)), given in zip(fresh.items(), self.index.given(list(fresh.values())), strict=True):
            self._seen[key] = self.index.top(at, w, self.k + 1, given) if len(at) and self.ids else []
        found = [self._seen[key] for key in keys]
        return [[x for x in f if not leave or self.ids[x[1]] != leave[i]][: self.k] for i, f in enumerate(found)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        at = [x[1] for x in near]
        w = -np.array([x[0] for x in near]) * self.stands_for[at]
        return round(float((w * self.labels[at]).sum() / w.sum()), 6)

    def fit(self, votes: list[tuple[float, int, float]]) -> Model:
        """Calibrate by leave-one-out votes (vote, label, what the row stands for)."""
        if votes:
            self.knots = isotonic(*np.array(votes, dtype=float).T)
        return self

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """The calibrated score of each text, and the ids of its nearest examples."""
        out = []
        for near in self.near([self.vocabulary.counts(t) for t in texts]):
            if near:
                vote = self.vote(near)
                out.append((float(np.clip(np.interp(vote, *self.knots) if self.knots else vote, 0, 1)), [self.ids[x[1]] for x in near[:3]]))
            else:
                out.append((min(1.0, max(0.0, self.empty_rate)), []))
        return out

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}


def weights_of(features: list[tuple[str, int, int]], rows: int, toxic: int) -> dict[str, float]:
    """The weight of each (feature, documents, toxic documents): idf times c / (c + 2 ln V)."""
    share, chance = toxic / max(1, rows), 2 * math.log(max(2, len(features)))
    out = {}
    for feature, n, t in features:
        spread = n * share * (1 - share) * (1 - n / (rows + 1))
        c = (t - n * share) ** 2 / spread if spread > 0 else 0.0
        out[feature] = math.log((rows + 1) / n) * (c / (c + chance) if 0 < share < 1 else 1.0)
    return out


def train(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> Model:
    """From (doc_id, text) and (doc_id, toxic). A document with several labels is toxic if one says so."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows at most
    rate = {y: min(1.0, max_per_label / n) for y, n in sizes.items()}
    share = F.when(F.col("toxic") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0)))
    chosen = marked.filter(hash_unit(F.lit("toxicity"), F.col("doc_id")) < share)  # about max_per_label ids of each label
    # One text an id, so the sample is as small as the ids are few.
    rows = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            seen: Counter = Counter()
            hits: Counter = Counter()
            for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                own = {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}
                seen.update(own)
                if y:
                    hits.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([hits[f] for f in seen], pa.int64())], ["feature", "n", "t"])

    found = rows.select("text", "toxic").mapInArrow(emit, "feature string, n bigint, t bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    kept = found.filter("n >= 2").toPandas()  # terms of the sampled texts
    features = list(zip(kept.feature.tolist(), kept.n.tolist(), kept.t.tolist(), strict=True))
    vocabulary = Vocabulary(weights_of(features, total, toxic))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, n = zip(*(vocabulary.counts(t) for t in part.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))], ["doc_id", "toxic", "at", "n"])

    got = rows.mapInArrow(vectors, "doc_id bigint, toxic int, at array<bigint>, n array<bigint>").toArrow()  # a row for each sampled id
    lists = lambda c: [np.asarray(x.values) for x in got.column(c)]
    examples = list(zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), zip(lists("at"), lists("n"), strict=True), strict=True))
    stands_for = {y: 1 / r for y, r in rate.items()}
    model = Model(vocabulary, sorted(examples, key=lambda r: r[0]), stands_for)

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            ids, toxic, texts = (part.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))
            for y, near in zip(toxic, model.near([vocabulary.counts(t) for t in texts], leave=ids), strict=True):
                if near:
                    out.append((model.vote(near), y, stands_for[y]))
            v, y, w = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()), pa.array(y, pa.int32()), pa.array(w, pa.float64())], ["vote", "toxic", "weight"])

    return model.fit(sorted(map(tuple, rows.mapInArrow(leave_one_out, "vote double, toxic int, weight double").collect())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence): evidence has the ids of up to three nearest examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = model.score(part.column("text").to_pylist())
            s = np.array([x[0] for x in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int, evidence array<bigint>")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    return filtered(docs, lambda texts: np.array([x[0] for x in model.score(texts)]) < threshold)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score all documents."""
    model = train(docs, labels.filter(~is_held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
