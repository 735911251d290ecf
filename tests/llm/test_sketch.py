import hashlib
import math
import re

import pytest
import xxhash

from quiverlake.llm import sketch


def pieces(text):
    return {xxhash.xxh64_intdigest(p.rstrip(" ").encode(), 42) for p in re.findall(r"(?:\S+[^\S\n]*){1,%d}" % sketch.WORDS, text, re.ASCII)}


def likeness(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def brute(docs):
    """Rows of equal id in any order of their texts that their checksums give: tests have one text an id, or say so."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own = pieces(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, pieces(edited)), 12), round(likeness(own, pieces(after)), 12), t, edited))
    return out


def check(spark, docs):
    got = sketch.versions(spark.createDataFrame(docs, "doc_id bigint, text string, rid string")).collect()
    want = brute([d[:2] for d in docs])
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:5])
    mine = sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got], key=key)
    assert mine == sorted([w[:5] for w in want], key=key)
    of = {}
    ids = {w[0]: w for w in want}
    if len(ids) == len(docs):
        for r in got:
            for text, fp in ((ids[r.doc_id][5], r.fingerprint), (ids[r.doc_id][6], r.edited_fingerprint)):
                assert of.setdefault(text, fp) == fp
    return got


def test_table(spark, sf_dir):
    docs = [(r.doc_id * 7, r.text, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = check(spark, docs)
    assert sum(r.near_edited for r in got) / len(got) > 0.6 > 0.2 > sum(r.near_next for r in got) / len(got)


def test_ids_beyond_doubles(spark):
    check(spark, [((1 << 62) + 3 * i, f"text {i} of many", "x") for i in range(100)] + [(i * 0x123456789ABCDE1 % (1 << 63), "h " * i, "x") for i in range(1, 100)] + [(None, "n", "x")])


def test_edges(spark, monkeypatch):
    long = "\n".join(f"line {i} of a text that goes on" for i in range(3000))
    docs = [(1, None), (2, ""), (2, ""), (3, "a"), (4, "é漢\U0001f600 x\n\ny"), (5, long), (5, long), (6, long + " z"), (None, "null id"), (7, " \n\t "), (8, "same same same\n" * 50)]
    check(spark, [(*d, "x") for d in docs])
    check(spark, [(1, "only one document here", "x")])
    assert sketch.versions(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_recovers_digests(spark, monkeypatch, most):
    monkeypatch.setattr(sketch, "MAX_BROADCAST", most)
    a, b = list(range(1, 400)), list(range(200, 420))
    rows = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], b), (4, [7], [8])], "rid bigint, a array<bigint>, b array<bigint>")
    pairs = sketch.F.expr("array(struct(1 AS pair, a, b))")
    got = {r.rid: (sorted(r.plus), sorted(r.minus)) for r in sketch.differences(rows, pairs).collect()}
    assert got[1] == (list(range(1, 200)), list(range(400, 420)))
    assert got.get(2, ([], [])) == ([], []) and got[3] == ([], b) and got[4] == ([7], [8])


def test_likeness_is_that_of_the_two_rows_fingerprints(spark):
    """Two documents, each the other's next: equal near_next; an id that many rows and texts share is one range of rows."""
    line = lambda words: " ".join(words)
    one = "\n".join(line(f"w{i}x{j}" for j in range(30)) for i in range(40))
    two = "\n".join(line(f"w{i}x{j}" for j in range(30)) for i in range(10, 90))
    got = sketch.versions(spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")).collect()
    assert got[0].near_next == got[1].near_next and abs(got[0].near_next - 0.5) < 0.01
    docs = [(5, one)] * 30 + [(6, f"text {i}") for i in range(60)]
    got = sketch.versions(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 90 and sum(r.near_next == 1 for r in got) == 29 and len({r.fingerprint for r in got}) == 61
