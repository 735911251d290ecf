"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces.

A text is cut at line ends, and longer lines into pieces of WORDS words; the rule is the same for every text, so the
digests (64 bits of XXH64 a piece, as a set) of any two texts can be compared. A sketch has three tables of CELLS
cells; a digest falls into one cell of each, which keeps the count, the XOR of its digests and the XOR of their check
hashes. The sketches of two versions are subtracted cell by cell: what both have cancels out. Peeling then looks for
cells that hold one digest (count 1 or -1 and a fitting check), takes it out of its cells, and goes on; when every
cell is empty, the differing digests of both sides are recovered. The digests of a pair are dealt by a hash into parts
of about PART, by the number of digests on both sides, each part with a sketch of its own. What cannot be peeled is
built again larger: each quarter of such a part gets a sketch of that size, with other cells, until all are peeled.

The fingerprint is the text's one sketch of the smallest size, as text: number of digests, then the cells. The
likeness of two fingerprints is 1 - (differing digests) / (digests of one + digests of the other), of the digests
that they sketch; it is symmetric, 1 for equal sets, 0 for sets with nothing in common.

Only DataFrame functions. Cells are columns: one aggregation with a fixed buffer for each sketch builds them,
subtraction is its sign, and peeling is a chain of projections, so no table of cells is ever grouped again. The order
of documents comes from ids and checksums alone; each text then meets the beginning and the digests of its next
document by an equi-join.

Cases: a null text is an empty one; two texts without digests have likeness 1, with one such it is 0. Texts of any
length are read whole. Rows with equal ids stand in the order of their checksums, null ids come first. Rows that
repeat both id and text are one row with a count until the end (they are combined before the shuffle): each is the
next document of the one before it. One document alone is its own next. An empty table gives an empty table. Only
doc_id and text of the input are looked at, so other columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Words of a piece at most; cells of a table; digests of both sides that a part has on average.
WORDS, CELLS, PART = 24, 4, 2.0
TABLES = 3
#: Failed parts up to this many are broadcast, about 60 bytes each; more are joined by shuffle.
MAX_BROADCAST = 200_000
#: Turns of peeling, one table each; more is left to the next size.
TURNS = 6
_PIECE = rf"(?:\S++[^\S\n]*+){{1,{WORDS}}}+"
_NAMES = [f"{f}{t}_{i}" for t in range(TABLES) for i in range(CELLS) for f in "nkh"]


def digests(text: Column) -> Column:
    """Distinct digests of the pieces; white space at the end of a piece does not count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def _check(digest: str) -> str:
    return f"xxhash64({digest}, 'check')"


def _at(digest: str, table: int) -> str:
    """The digest's cell in a table; the part's number is the salt."""
    return f"int(pmod(shiftright(xxhash64({digest}, part), {16 * table}), {CELLS}))"


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row of cell columns for each value of the keys (part among them), from rows with a digest k or null and its sign c."""
    rows = rows.selectExpr(*keys, "c AS n", "k", f"{_check('k')} AS h", *[f"{_at('k', t)} AS at{t}" for t in range(TABLES)])
    fold = {"n": "sum", "k": "bit_xor", "h": "bit_xor"}
    cells = [f"{fold[c[0]]}(if(at{c[1]} = {c[3:]}, {c[0]}, 0L)) AS {c}" for c in _NAMES]
    return rows.groupBy(*keys).agg(*map(F.expr, cells))


def _turn(cells: DataFrame, keys: list[str], t: int) -> DataFrame:
    """Cells of table t with one digest give it up: it leaves the cells of all tables and goes into `found`."""
    pure = []
    for i in range(CELLS):
        one = f"abs(n{t}_{i}) = 1 AND {_check(f'k{t}_{i}')} = h{t}_{i}"
        pure += [f"if({one}, {f}{t}_{i}, 0L) AS p{f}_{i}" for f in "nkh"]
        pure += [f"{_at(f'k{t}_{i}', o)} AS at{o}_{i}" for o in range(TABLES) if o != t]
    out = []
    for name in _NAMES:
        f, table, i = name[0], int(name[1]), int(name[3:])
        gone = [f"p{f}_{i}"] if table == t else [f"if(at{table}_{j} = {i}, p{f}_{j}, 0L)" for j in range(CELLS)]
        out.append((" - " if f == "n" else " ^ ").join([name, *gone]) + f" AS {name}")
    some = " OR ".join(f"pn_{i} <> 0" for i in range(CELLS))
    for side, n in (("plus", 1), ("minus", -1)):
        new = ", ".join(f"if(pn_{i} = {n}, pk_{i}, NULL)" for i in range(CELLS))
        out.append(f"if({some}, concat({side}, array_compact(array({new}))), {side}) AS {side}")
    return cells.selectExpr(*keys, *_NAMES, "plus", "minus", *pure).selectExpr(*keys, *out)


def peeled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shown, ok, plus, minus): the sketches as text where pair < 0, which are not peeled, and the digests that
    were recovered from the others, by their sign; ok if no cell is left.

    Group or write the result before filtering it: a filter would be pushed down through all turns.
    """
    count = " + ".join(f"n0_{i}" for i in range(CELLS))
    shown = ", ".join(f"if(n{c[1:]} <> 0, hex({c}), '-')" for c in _NAMES)
    none = "CAST(array() AS array<bigint>)"
    cells = cells.selectExpr(*keys, f"if(pair < 0, lower(concat_ws('.', {count}, {shown})), NULL) AS shown", *_NAMES, f"{none} AS plus", f"{none} AS minus")
    for turn in range(TURNS):
        cells = _turn(cells, [*keys, "shown"], turn % TABLES)
    return cells.selectExpr(*keys, "shown", f"{' | '.join(_NAMES)} = 0 OR pair < 0 AS ok", "plus", "minus")


def _part(level: int) -> Column:
    """The part of a digest: dealt by a hash at first, then cut in four at each level; no number comes again on the way."""
    part = F.pmod(F.xxhash64("k", F.lit("part")), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("size") / PART))) + 1
    for step in range(level):
        part = part * 4 + F.shiftright(F.xxhash64("k", F.lit("cut")), 2 * step % 64).bitwiseAND(F.lit(3).cast("bigint"))
    return part


def differences(rows: DataFrame, pairs: Column, recover: bool = True) -> DataFrame:
    """(rid, pair, shown, plus, minus) of each pair of rows: the digests of a that b lacks, and the reverse, or their numbers.

    rows: a written table with a bigint rid; pairs: array<struct<pair int, a, b>> of its columns. A pair below 0 is not
    compared: its a is shown as one sketch. Pairs without digests have no row. Each size that is tried reads rows once.
    """
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = lambda keys, c: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(c).cast("bigint").alias("c")))
    keys = ["rid", "pair", "part"]

    def exploded(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("rid", *more, F.explode(pairs).alias("p")).select("rid", *more, "p.*")
        rows = rows.select("rid", "pair", *more, (F.size("a") + F.size("b")).alias("size"), F.explode(F.concat(signed(F.col("a"), 1), signed(F.col("b"), -1))).alias("e"))
        return rows.select("rid", "pair", *more, "size", "e.k", "e.c")

    got = "flatten(collect_list(if(ok AND size({0}) > 0, {0}, NULL))) AS {0}" if recover else "sum(if(ok, size({0}), 0)) AS {0}"
    done, failed, level = None, None, 0
    while True:
        if failed is None:
            found = exploded(rows.repartition(parts, "rid"))
        else:
            # The digests of the parts that failed, by a broadcast where those are few.
            failed = F.broadcast(failed) if n <= MAX_BROADCAST else failed
            found = exploded(rows.join(failed, "rid"), "failed").withColumn("part", _part(level - 1))
            found = found.filter(F.array_contains("failed", F.struct("pair", "part"))).drop("failed", "part").repartition(parts, "rid")
        found = found.select("rid", "pair", F.when(F.col("pair") < 0, F.lit(0).cast("bigint")).otherwise(_part(level)).alias("part"), "k", "c")
        # One row a pair: all that its parts gave, and the parts that gave not all.
        result = peeled(sketches(found, keys), keys).groupBy("rid", "pair")
        result = cut(result.agg(F.max("shown").alias("shown"), *[F.expr(got.format(side)) for side in ("plus", "minus")], F.expr("collect_list(if(ok, NULL, struct(pair, part))) AS failed")))
        fine = result.drop("failed")
        done = fine if done is None else done.unionByName(fine)
        failed = result.filter(F.size("failed") > 0).groupBy("rid").agg(F.flatten(F.collect_list("failed")).alias("failed"))
        n, = result.agg(F.coalesce(F.sum(F.size("failed")), F.lit(0))).first()
        if not n:
            break
        level += 1
    joined = lambda side: (F.flatten(F.collect_list(side)) if recover else F.sum(side)).alias(side)
    return done.groupBy("rid", "pair").agg(F.max("shown").alias("shown"), joined("plus"), joined("minus"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, copies, beginning, next_digests), one row for each different (doc_id, text).

    beginning: the first n_chars div 4 characters of the next row's text; next_digests: those of its whole text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    key = ("known", "id", "crc")
    rows = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("id"), F.xxhash64(text).alias("crc"), text.alias("text"))
    classes = rows.select(*key, F.length("text").cast("bigint").alias("n_chars")).groupBy(*key).agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    placed, n, _ = numbered(cut(classes), *key)
    before = placed.select(*[F.col(c).alias(f"to_{c}") for c in key], (F.col("n_chars").bitwiseAND(F.lit(-4).cast("bigint")) / 4).cast("int").alias("wanted"), F.pmod(F.col("row") + 1, F.lit(max(1, n))).alias("row"))
    order = cut(placed.join(before, "row").drop("row"))
    texts = rows.groupBy(*key).agg(F.first("text").alias("text")).join(order, list(key))
    sent = texts.select(*[F.col(f"to_{c}").alias(c) for c in key], F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("beginning"), digests(F.col("text")).alias("next_digests"))
    own = texts.select(*key, "text", "n_chars", "copies")
    return own.join(sent, list(key)).select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "text", "n_chars", "copies", "beginning", "next_digests")


def versions(docs: DataFrame) -> DataFrame:
    """The digest row of every document: its fingerprint, its edited text's, and both likenesses.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of equal rows, all but one have an equal next row.
    times = lambda again, n: F.struct(F.lit(again).alias("again"), n.cast("bigint").alias("times"))
    last, rest = times(False, F.lit(1)), times(True, F.col("copies") - 1)
    rows = with_next(docs).select("*", F.explode(F.when(F.col("copies") > 1, F.array(last, rest)).otherwise(F.array(last))).alias("e"))
    kept, quarter = F.col("n_chars") - F.floor(F.col("n_chars") / 4), F.floor(F.col("n_chars") / 4).cast("int")
    start = lambda text, n: F.substring(text, F.lit(1), n.cast("int"))
    edited = F.concat(start(F.col("text"), kept), F.when(F.col("e.again"), start(F.col("text"), quarter)).otherwise(F.col("beginning")))
    rows = rows.select("doc_id", "n_chars", "e.*", edited.alias("edited"), digests(F.col("text")).alias("own"), "next_digests")
    after = F.when(F.col("again"), F.col("own")).otherwise(F.col("next_digests"))
    rows = rows.select("doc_id", "n_chars", "times", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), after.alias("after"))
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))

    none = F.array().cast("array<bigint>")
    pair = lambda n, a, b: F.struct(F.lit(n).alias("pair"), F.col(a).alias("a"), (F.col(b) if b else none).alias("b"))
    pairs = F.array(pair(-1, "own", None), pair(-2, "changed", None), pair(1, "own", "changed"), pair(2, "own", "after"))
    found = differences(rows.select("rid", "own", "changed", "after"), pairs, recover=False)
    of = lambda n, value: F.max(F.when(F.col("pair") == n, value))
    apart = F.col("plus") + F.col("minus")
    found = found.groupBy("rid").agg(of(-1, F.col("shown")).alias("f0"), of(-2, F.col("shown")).alias("f1"), of(1, apart).alias("apart1"), of(2, apart).alias("apart2"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("own", "changed", "after")]
    out = rows.select("rid", "doc_id", "n_chars", "edited_sha256", "times", *sizes).join(found, "rid", "left")
    empty = F.lit(".".join(["0", *["-"] * len(_NAMES)]))
    near = lambda p, name: F.coalesce(1 - F.try_divide(F.coalesce(F.col(f"apart{p}"), F.lit(0)), F.col("n_own") + F.col(f"n_{name}")), F.lit(1.0))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    out = out.withColumns({"fingerprint": F.coalesce("f0", empty), "edited_fingerprint": F.coalesce("f1", empty)})
    return out.select(*names, near(1, "changed").alias("near_edited"), near(2, "after").alias("near_next"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("col")
