import zlib

import numpy as np

from quiverlake.llm import language


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in out} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_by_brute_force():
    dice = np.random.default_rng(1)
    prob = dice.random((1 << language.BITS, 3))
    model = language.Model(["a", "b", "c"], np.log([0.5, 0.3, 0.2]), np.log(prob / prob.sum(axis=0)).astype(np.float32))
    texts = ["Ab cd!", "x", None, "12 .", "é" * 50, "word " * 400, "", "漢字 kana"]
    joint = model.log_joint(texts)
    for text, row in zip(texts, joint, strict=True):
        text = language.letters(text)
        if not text:
            assert np.isnan(row).all()
            continue
        want = model.log_prior.copy()
        for buckets in language.hashed(language.codes_of(text)):
            for b in buckets:
                want += model.log_prob[b]
        assert np.allclose(row, want)


def test_whole_table_by_brute_force(spark, sf_dir):
    """Counts and scores of every document, with plain dictionaries of hashed grams."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    langs = sorted({r.lang for r in learned})
    grams = lambda text: np.concatenate(language.hashed(language.codes_of(language.letters(text)))) if language.letters(text) else np.zeros(0, int)
    table = np.full((1 << language.BITS, len(langs)), language.SMOOTHING)
    for r in learned:
        np.add.at(table[:, langs.index(r.lang)], grams(r.text), 1)
    prob = np.log(table / table.sum(axis=0)).astype(np.float32).astype(float)
    prior = np.log([sum(r.lang == x for r in learned) / len(learned) for x in langs])
    got = {r.doc_id: r for r in language.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in rows:
        joint = prior + prob[grams(r.text)].sum(axis=0)
        p = np.exp(joint - joint.max())
        if language.letters(r.text):
            assert got[r.doc_id].lang_pred == langs[joint.argmax()] and abs(got[r.doc_id].score - (p / p.sum()).max()) < 1e-6
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(1, "abc", "y"), (3, "abc", "x"), (4, "abc", None)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language.predict(docs, language.train(docs)).collect()} == {"x"}


def test_long_text_in_pieces(monkeypatch):
    model = language.Model(["a"], np.zeros(1), np.full((1 << language.BITS, 1), -1, np.float32))
    monkeypatch.setattr(language, "PIECE", 64)
    assert model.log_joint(["word " * 1000])[0, 0] < -3 * 4900


def test_edges(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 !", None, "x"), (4, "hello there", "en", "x"), (4, "hello there", "en", "x"), (None, "bonjour", "fr", "x"), (6, "bonjour la vie " * 9000, "fr", "x"), (7, "hello world", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()]
    assert sorted(i for i, lang, _ in got if lang == "und") == [1, 2, 3] and len(got) == 8
    assert [lang for i, lang, _ in got if i == 7] == ["en"]
    assert all(s == 0 for _, lang, s in got if lang == "und")
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def test_keep(spark):
    docs = spark.createDataFrame([(1, "hello there friend", "en", "s", 3), (2, "...", "en", "s", 3), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = language.keep(docs, language.train(docs), 0.5)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
