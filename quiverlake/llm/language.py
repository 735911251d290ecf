"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased letters by language on a bounded sample (at most about
SAMPLE_PER_LANG documents of each language, chosen by a hash of the id); the smoothed log probabilities are one
float32 matrix of 2 ** BITS rows and a column for each language, a broadcast variable: 128 KB a language, and at most
MAX_LANGS languages are learned (more are an error). Scoring hashes
the n-grams of a few texts at a time in numpy and adds up their matrix rows by text.

score is the posterior probability of the predicted language.

Cases: a text that is null or has no letter is `und` with score 0. Very long texts are scored whole, in overlapping
pieces. With no training rows every text is `und`; an empty table gives an empty table. Ties go to the language first
in order. Repeated rows are counted as often as they occur in training and predicted alike. Only doc_id, text and (in
training) lang of the input are looked at, so other columns clash with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import filtered, slices
from .common import hash_unit, is_held_out

BITS = 15
#: Expected number of documents of a language that training reads.
SAMPLE_PER_LANG = 2000
#: Texts up to this many characters are hashed together; a longer one is hashed in pieces of this size.
PIECE = 1 << 18
SMOOTHING = 0.5
#: Languages that a model may have, so that its matrix stays below 128 MB.
MAX_LANGS = 1000
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, each with a space before and after."""
    words = _LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of the n-grams that start at each place, for n = 1, 2, 3; shorter at the end."""
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(3):
        h = (h[: len(codes) - n] ^ codes[n:]) * _MIX[n]
        h = h ^ (h >> np.uint32(15))
        out.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces_of(text: str) -> Iterator[np.ndarray]:
    """The codes of a text in overlapping pieces, so that each n-gram of three occurs in one of them."""
    codes = codes_of(text)
    for at in range(0, max(1, len(codes) - 2), PIECE):
        yield codes[at : at + PIECE + 2]


class Model:
    def __init__(self, langs: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.langs, self.log_prior, self.log_prob = langs, log_prior, log_prob

    def log_joint(self, texts: list[str | None]) -> np.ndarray:
        """A row of log joint probabilities for each text; NaN where the text has no letter."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        group: list[tuple[int, np.ndarray]] = []
        size = 0

        def score() -> None:
            nonlocal size
            codes = np.concatenate([c for _, c in group])
            ends = np.cumsum([len(c) for _, c in group])
            starts = np.concatenate([[0], ends[:-1]])
            at = np.arange(len(codes))
            limit = np.repeat(ends, ends - starts)
            for n, buckets in enumerate(hashed(codes)):
                rows = self.log_prob[buckets].astype(np.float64)
                rows[at[: len(buckets)] + n >= limit[: len(buckets)]] = 0  # n-grams across two texts
                sums = np.add.reduceat(rows, np.minimum(starts, len(rows) - 1), axis=0) if len(rows) else 0
                for (i, c), s in zip(group, sums, strict=True) if len(rows) else ():
                    if len(c) > n:
                        out[i] += s
            group.clear()
            size = 0

        for i, text in enumerate(texts):
            text = letters(text)
            if not text:
                continue
            out[i] = self.log_prior
            for codes in pieces_of(text):
                group.append((i, codes))
                size += len(codes)
                if size >= PIECE:
                    score()
        if group:
            score()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        joint = self.log_joint(texts)
        none = np.isnan(joint[:, 0])
        joint[none] = 0
        best = joint.argmax(axis=1)
        p = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
        return ["und" if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, p)


def train(rows: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """From (doc_id, text, lang); rows without text or language are left out."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").alias("label"))
    sizes = rows.groupBy("label").count().limit(MAX_LANGS + 1).collect()  # a row for each language
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    if not sizes:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0), dtype=np.float32))
    total = sum(r["count"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.label, min(1.0, sample_per_lang / r["count"]))])
    sample = rows.filter(hash_unit(F.lit("language"), F.col("doc_id")) < share[F.col("label")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BITS, dtype=np.int64)
                for codes in pieces_of(letters(text)) if letters(text) else ():
                    for buckets in hashed(codes):
                        seen[lang] += np.bincount(buckets, minlength=1 << BITS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"])

    counted = sample.select(F.col("label").cast("string"), "text").mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(str(r.label) for r in sizes)
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    got = counted.toPandas()  # at most languages * 2 ** BITS rows
    table[got.bucket.to_numpy(dtype=np.int64), got.label.map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] += got.n.to_numpy(dtype=float)
    prior = {str(r.label): np.log(r["count"] / total) for r in sizes}
    return Model(langs, np.array([prior[x] for x in langs]), np.log(table / table.sum(axis=0)).astype(np.float32))


def _sent(docs: DataFrame, model: Model) -> Broadcast:
    """The model's numbers as a broadcast variable: each executor fetches them once."""
    return docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prior, model.log_prob))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) from doc_id and text alone."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for part in slices(batches):
            lang, score = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose language is known with a posterior of at least `least`."""

    sent = _sent(docs, model)

    def certain(texts: list[str | None]) -> np.ndarray:
        lang, score = Model(*sent.value).predict(texts)
        return np.array([x != "und" for x in lang]) & (score >= least)

    return filtered(docs, certain)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold, then predict all of them."""
    model = train(docs.filter(~is_held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
