import random

from pyspark.sql import functions as F
from tokenizers import models

from quiverlake.llm import wordpiece


def library(starts, continues):
    names = list(dict.fromkeys(["[UNK]", *starts, *("##" + c for c in continues)]))
    return models.WordPiece({n: i for i, n in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**9)


def expected(model, word):
    got = [t.value for t in model.tokenize(word)]
    return None if got == ["[UNK]"] else len(got)


def test_random_vocabularies():
    dice = random.Random(3)
    for _ in range(60):
        make = lambda: "".join(dice.choice("abc") for _ in range(dice.randint(1, 6)))  # noqa: B023, E731
        starts, continues = {make() for _ in range(dice.randint(1, 12))}, {make() for _ in range(dice.randint(1, 12))}
        matcher, model = wordpiece.Matcher(starts, continues), library(starts, continues)
        for _ in range(200):
            word = "".join(dice.choice("abcd" if dice.random() < 0.1 else "abc") for _ in range(dice.randint(1, 12)))
            assert matcher.tokens(word) == expected(model, word), (starts, continues, word)


def test_rows(spark, sf_dir):
    starts, continues = wordpiece.default_vocabulary()
    model = library(starts, continues)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in wordpiece.token_counts(docs).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        words = wordpiece.WORD.findall(row.text)
        counts = [expected(model, w) for w in words]
        r = got[row.doc_id]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(1 if c is None else c for c in counts), counts.count(None))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "a" * 100_000), (4, "a" * 100_000), (None, "漢� x")], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs).collect())
    assert got[1:4] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)] and got[4] == got[5] and got[4][1] == 1
    assert wordpiece.token_counts(docs.limit(0)).count() == 0
