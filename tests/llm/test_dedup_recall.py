import random

import numpy as np
import pytest

from quiverlake.llm import simhash

_DICE = random.Random(5)
VOCABULARY = ["".join(_DICE.choice("abcdefgh") for _ in range(_DICE.randint(3, 8))) for _ in range(20_000)]


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def kept(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id for r in simhash.deduplicated(rows).collect()}


def edited(dice, base, kind, low, high):
    """A copy of base with one contiguous edit, of a likeness in [low, high)."""
    more = lambda n: [dice.choice(VOCABULARY) for _ in range(n)]
    for n in range(1, len(base)):
        at = (len(base) - n) // 2
        text = {"block": base[:at] + more(n) + base[at + n :], "append": base + more(n), "cut": base[: len(base) - n]}[kind]
        if low <= jaccard(base, text) < high:
            return text
    raise AssertionError(kind)


def test_copies_inside_a_family_with_a_template(spark):
    """Members share a long template and are not alike; each has one copy, which only a pair inside the bucket shows."""
    dice = random.Random(3)
    template = [dice.choice(VOCABULARY) for _ in range(300)]
    texts = []
    for _ in range(300):
        own = [dice.choice(VOCABULARY) for _ in range(60)]
        texts += [template + own, template + own[:17] + [dice.choice(VOCABULARY) for _ in range(25)] + own[42:]]
    assert all(jaccard(texts[i], texts[i + 1]) >= 0.84 for i in range(0, 600, 2)) and max(jaccard(texts[0], t) for t in texts[2:]) < 0.8
    left = kept(spark, texts)
    print("family found", 300 - sum(i in left for i in range(1, 600, 2)), "of 300")
    assert all(i in left for i in range(0, 600, 2)) and sum(i in left for i in range(1, 600, 2)) <= 3


@pytest.mark.parametrize("kind", ["block", "append", "cut"])
def test_contiguous_edits_near_the_limit(spark, kind):
    dice = random.Random(4)
    texts = []
    for i in range(300):
        base = [dice.choice(VOCABULARY) for _ in range(300)]
        texts += [base, edited(dice, base, kind, 0.80 + 0.02 * (i % 2), 0.83 + 0.02 * (i % 2))]
    left = kept(spark, texts)
    assert all(i in left for i in range(0, 600, 2))
    print(kind, "found", 300 - sum(i in left for i in range(1, 600, 2)), "of 300")
    assert sum(i in left for i in range(1, 600, 2)) <= 9


def test_long_texts_at_the_limit_are_compared_whole(spark):
    dice = np.random.default_rng(6)
    scattered = random.Random(6)
    texts, due = [], []
    for i in range(160):
        base = [VOCABULARY[k] for k in dice.integers(0, len(VOCABULARY), 1500)]
        copy = list(base)
        while jaccard(base, copy) >= (0.802 if i % 2 else 0.798):
            last = list(copy)
            copy[scattered.randrange(1500)] = scattered.choice(VOCABULARY)
        copy = last if i % 2 else copy
        due.append(jaccard(base, copy) >= 0.8)
        texts += [base, copy]
    left = kept(spark, texts)
    wrong = [i for i, d in enumerate(due) if (2 * i + 1 in left) == d]
    print("wrong", len(wrong), "of 160")
    assert 60 < sum(due) < 100 and len(wrong) <= 1


def test_rows_grow_with_a_family_and_not_with_its_pairs(spark):
    """No two members are alike, all meet: what the search makes of 400 and of 800 of them differs by a factor of two."""
    dice = random.Random(8)
    template = [dice.choice(VOCABULARY) for _ in range(300)]
    texts = [template + [dice.choice(VOCABULARY) for _ in range(60)] for _ in range(800)]
    assert jaccard(texts[0], texts[1]) < 0.8

    def made(n):
        rows = [(i, simhash.fingerprint(t, 3, simhash.WORDS, once=True), simhash.shingle_set(t, 5)) for i, t in enumerate(map(" ".join, texts[:n]))]
        nodes = [(i, np.array(f, "<u8").tobytes(), simhash.anchors(s).tobytes(), len(s) * 4, s.tobytes()) for i, f, s in rows]
        table = spark.createDataFrame([(i, bytearray(f), bytearray(a), w, bytearray(s)) for i, f, a, w, s in nodes], "w0 bigint, bits binary, anchors binary, weight bigint, shingles binary").cache()
        return simhash.meetings(table.drop("weight", "shingles")).count(), simhash.alike_links(table.drop("shingles"), table).count()

    (few, none), (many, neither) = made(400), made(800)
    assert none == neither == 0 and 400 <= few < many <= 3 * few < 400 * 399 / 2 / 4


def test_families_of_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40_000)
    test_copies_inside_a_family_with_a_template(spark)


def test_alike_rows_by_brute_force():
    dice = np.random.default_rng(9)
    sets = [np.zeros(0, np.uint32)]
    for _ in range(40):
        base = np.unique(dice.integers(0, 400, dice.integers(1, 60), dtype=np.uint32))
        for _ in range(5):
            sets.append(np.unique(np.where(dice.random(len(base)) < 0.06, dice.integers(0, 400, len(base), dtype=np.uint32), base)))
    sets = [sets[i] for i in dice.permutation(len(sets))]
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(np.union1d(a, b)) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8}
    found = simhash.alike_rows(sets)
    assert {tuple(sorted(p)) for p in found} <= near and len(found) < len(sets) < len(near)

    def parts(edges):
        at = list(range(len(sets)))
        for _ in sets:
            for i, j in edges:
                at[i] = at[j] = min(at[i], at[j])
        return at

    assert parts(near) == parts(found)


def test_keys_of_equal_segments_but_for_one_bit():
    """Of two fingerprints a segment with no differing bit shares all variants, with one its one, with two none."""
    dice = np.random.default_rng(10)
    a = dice.integers(0, 2**63, simhash.WORDS, dtype=np.uint64)
    b = a ^ np.array([1 << 3 | 0b101 << 8, 0], dtype=np.uint64)
    anchor = dice.integers(0, 2**63, (1, simhash.SEGMENTS), dtype=np.uint64).repeat(2, axis=0)
    x, y = simhash.variants(np.stack([a, b]), anchor).reshape(2, simhash.SEGMENTS, simhash.SEGMENT)
    same = x == y
    assert same[0].tolist() == [k == 3 for k in range(8)] and not same[1].any() and same[2:].all()
    assert len(set(x.ravel().tolist())) == simhash.KEYS
