import random
import re

import numpy as np
import xxhash

from quiverlake.llm import components, simhash


def plain(text, width=3):
    """The definition, written plainly."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    at = list(range(n))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        at[b] = a
    return [top(i) for i in range(n)]


def check(spark, docs):
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string, component_id string")).collect()
    prints = [plain(t) for _, t, _ in docs]
    x = np.array(prints, dtype=np.uint64)
    edges = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1]
    top = roots(len(x), edges)
    low = {}
    for (i, _, _), r in zip(docs, top, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i is None, i), f"{p:016x}", low.get(r)) for (i, _, _), p, r in zip(docs, prints, top, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    return edges


def test_table_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(spark, docs)


def test_edges(spark):
    dice = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    base = [dice.choice(words) for _ in range(300)]
    docs = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "One", "a"), (4, "one", "a"), (5, "a b", "a"), (None, "É é", "a"), (7, "x " * 50_000, "a"), (7, "x " * 50_000, "a")]
    for i in range(150):
        text = list(base)
        for _ in range(dice.randint(0, 2)):
            text[dice.randrange(300)] = dice.choice(words)
        docs.append((100 + i, " ".join(text), "a"))
    check(spark, docs)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_links_lose_nothing(spark):
    dice = np.random.default_rng(4)
    base = dice.integers(0, 2**63, 5, dtype=np.uint64)
    x = {int(b) for b in base}
    for b in base:
        for _ in range(200):
            v = int(b)
            for bit in dice.integers(0, 64, dice.integers(1, 4)):
                v ^= 1 << int(bit)
            x.add(v)
    x = np.array(sorted(x), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "w0 bigint")
    found = {r.node: r.root for r in components.connected_components(simhash.links(nodes, 2, 32, 2)).collect()}
    edges = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1]
    signed = x.view(np.int64).tolist()
    mine = {}
    for v, r in zip(signed, roots(len(x), edges), strict=True):
        mine.setdefault(r, set()).add(v)
    theirs = {}
    for v in signed:
        theirs.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 300), (300, 200), (5, 5)], "a bigint, b bigint")
    found = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(71)} | {200: 200, 300: 200}


def test_deduplicated(spark):
    dice = random.Random(7)
    long = [f"t{dice.randrange(500)}" for _ in range(400)]
    near = list(long)
    near[200] = "changed"
    docs = [(3, " ".join(long), "k"), (2, " ".join(near), "k"), (2, " ".join(near), "k"), (9, " ".join(reversed(long)), "k"), (10, None, "k"), (11, "", "k")]
    got = simhash.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string, w0 string"))
    assert got.columns == ["doc_id", "text", "w0"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 9, 10]


def test_deduplicated_finds_alike_texts(spark):
    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 6)))
    docs, groups = [], []
    for g in range(120):
        base = [word() for _ in range(dice.randint(120, 600))]
        group = [base]
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[dice.randrange(len(copy))] = word()
            group.append(copy)
        groups.append([len(docs) + i for i in range(4)])
        docs += [(len(docs) + i, " ".join(t)) for i, t in enumerate(group)]
        docs.append((len(docs), " ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)])))  # shares half only
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in docs}
    due = [i for g in groups for i in g[1:] if len(sets[i] & sets[g[0]]) >= 0.8 * len(sets[i] | sets[g[0]])]
    assert len(due) > 150 and sum(i in kept for i in due) <= 0.03 * len(due)
    assert all(g[0] in kept and g[0] + 4 in kept for g in groups)


def test_working_names_are_free(spark):
    rows = [(1, "one two three four five six", 7), (2, "one two three four five six", 7), (3, "another text of some words here", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __ql_id int").withColumn("__ql_n", simhash.F.lit("n"))
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
