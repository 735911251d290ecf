import math

from quiverlake.llm import urls


def parts(url):
    """The definition, written plainly."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def rule(host, path):
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


ODD = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/7?x#y", "http://example.com/en/71", "x://com/en/", "http://xcom/en/1", "http://İ.com/en/", "http://a.net\n/de/8", "http://example.net/de/80#/x", "a://b://c.org/es/", "http://h?u=http://z.com/en/", "http://h#://", "https://sub.example.org/es", "x" * 50_000 + "://org/es/"]


def test_brute_force(spark, sf_dir):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(r.page_id + 1000, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    for i, u in rows:
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aab.b",), ("é漢a",)], "t string")
    expect = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
    for r in rows.select("t", urls.entropy_of(rows["t"]).alias("h")).collect():
        assert abs(r.h - expect(r.t)) < 1e-12


def test_trees_learn():
    import numpy as np

    dice = np.random.default_rng(1)
    x = dice.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    y[:2000:10] = 1 - y[:2000:10]
    model = urls.Trees(x, y, np.ones(len(y)))

    def walk(node, row):
        return node if isinstance(node, float) else walk(node[2] if row[node[0]] < node[1] else node[3], row)

    raw = np.array([model.bias + sum(walk(t, r) for t in model.trees) for r in x[2000:]])
    assert ((raw > 0) == (y[2000:] > 0.5)).mean() > 0.95


def test_no_rows_or_one_kind(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://y.zz/"), (2, "http://y.zz/")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(one).collect()] == ["block"] * 3
    none = spark.createDataFrame([(1, "http://y.zz/", "q")], "page_id bigint, url string, host string")
    assert [(r.verdict, r.rule) for r in urls.judge(none).collect()] == [("allow", None)]
