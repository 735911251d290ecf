import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quiverlake.llm import pieces


@pytest.fixture(scope="module")
def pair():
    path = pieces.default_model()
    return pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)


CODEC = {}


def both():
    if not CODEC:
        path = pieces.default_model()
        CODEC["x"] = pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return CODEC["x"]


TEXTS = ["", " ", "  a", "a  ", "▁a", "<0x0A> <s>", "a\0b", "ﬁ Å", "x" * 3000, " " * 777, "tab\t\n\r", "漢字 \U0001f600 　 ", "aaaaaaaaab" * 50, "퟿"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(text):
    codec, library = both()
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    n, joined, decoded = codec.digest(text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabcdehinorst<>0xé漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    codec, library = both()
    ids = library.encode(text)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)


def test_any_ids():
    codec, library = both()
    dice = random.Random(5)
    for _ in range(300):
        ids = [dice.choice([dice.randrange(3, 32000), dice.randrange(3, 259), dice.randrange(0, 3)]) for _ in range(dice.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_table_rows(spark, sf_dir):
    codec, library = both()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in pieces.encode_digests(docs).collect()}
    import hashlib

    for row in docs.collect():
        ids = library.encode(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_null_empty_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "a b", "z"), (1, "a b", "z")], "doc_id bigint, text string, n_tokens string")
    assert sorted(r.n_tokens for r in pieces.encode_digests(docs).collect()) == [0, 0, 2, 2]
    back = pieces.decode_ids(pieces.encode_ids(docs))
    assert sorted(r.text for r in back.collect()) == ["", "", "a b", "a b"]
    assert pieces.encode_digests(docs.limit(0)).count() == 0
