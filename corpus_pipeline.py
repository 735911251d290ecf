"""The corpus pipeline: documents to token ids in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir), works on docs alone (sf_dir is read only for the toxicity labels), and
all but the last return the columns they get, whatever they are. Rows with a null doc_id are judged by their text
like any other, but have no near duplicates; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import language, mixing, pieces, simhash, toxicity
from quiverlake.llm.common import fresh, is_held_out

#: A document whose language is less certain than this goes, as does one without letters.
LEAST_CERTAIN = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, by their text alone; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~is_held_out(F.col("doc_id"))))
    return toxicity.keep(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of LEAST_CERTAIN or more."""
    model = language.train(docs.filter(~is_held_out(F.col("doc_id"))))
    return language.keep(docs, model, LEAST_CERTAIN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, likeness of 0.8 or more, met by SimHash segments."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights; a repeated document is a repeated row, in a global random order."""
    copy, key = fresh(docs.columns, "copy"), fresh(docs.columns, "key")
    return mixing.replicate(docs, copy_col=copy, key_col=key).drop(copy, key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as count and digests of ids and decoded text."""
    return pieces.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The stages score, predict and encode with models; SQL cannot express them (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
