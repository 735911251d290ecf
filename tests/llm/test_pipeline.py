import hashlib

import sentencepiece

import corpus_pipeline
from quiverlake.llm import pieces, queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "sentencepiece"]
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(before[r.doc_id] == r for r in docs.collect())  # rows pass unchanged
    counts = [d.count() for d in seen]
    assert len(before) >= counts[0] >= counts[1] >= counts[2] > 0.5 * len(before) and counts[3] == counts[4] > 0
    texts = [r.text for r in seen[2].collect()]
    assert len(texts) == len(set(texts))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r.doc_id, sha(",".join(map(str, library.encode(r.text))))) for r in seen[3].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in seen[4].collect()) == want


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words in a text", "en", "a", 15), (4, "words in a text " * 9000, "en", "a", 9), (4, "words in a text " * 9000, "en", "a", 9), (5, "other words of a text", "en", "b", 21)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, copy_no string, score int")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 4, 5}
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns
    assert corpus_pipeline.run(spark, _empty(spark, tmp_path, table)).count() == 0


def _empty(spark, tmp_path, table):
    folder = str(tmp_path / "empty")
    table.limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
