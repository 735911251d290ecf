import random
import zlib

import numpy as np

from quiverlake.llm import toxicity


def test_index_by_brute_force():
    dice = np.random.default_rng(2)
    for n, block in ((1, 4), (50, 4), (400, 16)):
        vectors = []
        for _ in range(n):
            at = np.sort(dice.choice(30, dice.integers(1, 5), replace=False))
            w = np.round(dice.random(len(at)), 1) + 0.1
            vectors.append((at, w / np.sqrt((w * w).sum())))
        index = toxicity.BlockMaxIndex(vectors, 30, block, full=dice.choice([1, 5, 1000]))
        dense = np.zeros((n, 30))
        for i, (at, w) in enumerate(vectors):
            dense[i, at] = w
        for _ in range(40):
            at, w = vectors[dice.integers(n)]
            scores = np.round(dense[:, at] @ w, 12)
            want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:7]
            got = index.top(at, w, 7)
            assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_blocks_save_postings():
    """Examples in families with terms of their own: searches read a fraction of the postings of the query's terms."""
    dice = np.random.default_rng(3)
    family = lambda f: np.sort(np.concatenate([[0, 1], 2 + f * 20 + dice.choice(20, 6, replace=False)]))
    vectors = [(family(i // 40), np.array([0.1, 0.1, *dice.random(6) + 0.5])) for i in range(2000)]
    vectors = [(at, w / np.sqrt((w * w).sum())) for at, w in vectors]
    index = toxicity.BlockMaxIndex(vectors, 1002, full=0)  # all terms have postings
    whole = 0
    for at, w in vectors[::50]:
        index.top(at, w, 15)
        whole += sum(int((index.end - index.start)[index.entries[t] : index.entries[t + 1]].sum()) for t in at)
    assert index.touched < whole / 5


def brute_scores(docs, labels):
    """The whole score by dense arithmetic: terms, weights, cosines, votes, leave-one-out calibration."""
    import math
    from collections import Counter

    learned = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}
    terms = lambda text: Counter(f for w in toxicity._WORD.findall(text.lower()) for f in toxicity.features_of(w))
    seen = {i: terms(docs[i]) for i in sorted(learned)}
    n, t = Counter(f for c in seen.values() for f in c), Counter(f for i, c in seen.items() if learned[i] for f in c)
    share, names = sum(learned.values()) / len(learned), sorted(f for f in n if n[f] > 1)

    def weight(f):
        c = (t[f] - n[f] * share) ** 2 / (n[f] * share * (1 - share) * (1 - n[f] / (len(learned) + 1)))
        return math.log((len(learned) + 1) / n[f]) * c / (c + 2 * math.log(len(names)))

    weights = np.array([weight(f) for f in names])

    def vector(c):
        v = np.array([1 + math.log(c[f]) if f in c else 0 for f in names]) * weights
        return v / max(1e-300, np.sqrt((v * v).sum()))

    ids = sorted(learned)
    dense, y = np.array([vector(seen[i]) for i in ids]), np.array([learned[i] for i in ids])

    def vote(v, leave=None):
        cos = np.round(dense @ v, 9)
        cos[[k for k, i in enumerate(ids) if i == leave]] = 0
        near = np.argsort(-cos, kind="stable")[: toxicity.NEIGHBOURS]
        assert cos[near[-1]] > 0
        w = cos[near]
        return (w * y[near]).sum() / w.sum()

    knots = toxicity.isotonic(np.round([vote(v, i) for i, v in zip(ids, dense, strict=True)], 6), y, np.ones(len(ids)))
    return {i: float(np.interp(round(vote(vector(terms(text))), 6), *knots)) for i, text in docs.items()}


def test_whole_score_by_brute_force(spark):
    docs, labels = planted(300)
    got = toxicity.rate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    want = brute_scores(dict(docs), dict(labels))
    apart = [abs(r.score - want[r.doc_id]) for r in got]
    assert np.mean(np.array(apart) < 1e-4) >= 0.99  # equal cosines at the last place may be ordered otherwise
    assert all(len(r.evidence) == 3 for r in got)


def test_most_documents_have_evidence(spark, sf_dir):
    d, l = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    got = toxicity.rate(d, l).collect()
    assert np.mean([len(r.evidence) > 0 for r in got]) > 0.95


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1])
    at, fit = toxicity.isotonic(x, y, np.ones(5))
    assert np.allclose(np.interp([1, 2, 3, 4], at, fit), [0, 0.5, 0.5, 1])


def planted(n=400):
    dice = random.Random(9)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(dice.randint(3, 7)))
    docs, labels = [], []
    for i in range(n):
        text = [word() for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for w in ("rotten", "zworth" + word(), "rotten"):
                text[dice.randrange(60)] = w
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_planted(spark):
    docs, labels = planted()
    docs += [(1000, "a clean text with nothing"), (1001, None), (1002, ""), (1003, "very rotten indeed " + "pad " * 30_000), (1003, "very rotten indeed " + "pad " * 30_000), (None, "rotten")]
    labels += [(5, None), (None, 1), (7777, 1), (5, 1), (5, 1)]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id bigint, text string, score string")
    l = spark.createDataFrame(labels, "doc_id bigint, toxic int")  # noqa: E741
    got = toxicity.rate(d, l).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    of = {r.doc_id: r for r in got}
    held = [of[i] for i, _ in labels[:400] if of[i].held_out]
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in held]
    assert len(held) > 60 and np.mean(right) >= 0.97
    assert of[1003].predicted == 1 and of[None].predicted == 1 and of[1003].evidence
    assert [of[i].predicted for i in (1000, 1001, 1002)] == [0, 0, 0]


def test_without_rows_or_labels(spark):
    d = spark.createDataFrame([(1, "x y")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.rate(d, none).collect()] == [(0.0, 0)]
    assert toxicity.rate(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0), (3, 0)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.rate(d, one).collect()] == [0]


def test_held_out_on_table(spark, sf_dir):
    d, l = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    got = toxicity.rate(d, l).join(l, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.85
