"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures.

A fingerprint has one 64-bit word or more; bit i says whether most shingles of the text have bit i in their hash
(XXH64, seed 42; further words mix the same hash with other constants). Fingerprints are cut into so few segments
that two which should meet differ by at most one bit in one of them. Each distinct fingerprint is indexed under
every segment and every segment with one bit blanked; equal keys meet in one place, where differing bits are
counted over the whole fingerprint. A bucket is not expanded into pairs: its members are joined into components by
search over the members not reached yet, so only one link for each member leaves it, and a bucket of like
fingerprints costs about its length. No bucket is capped; a worker holds one bucket at a time, 24 to 40 bytes a
distinct fingerprint.

deduplicated goes the same way to likeness instead of bits: segments of a fingerprint, each with one bit blanked in
turn and anchored by min-wise hashes, meet by equality of keys, differing bits are counted, and what met is checked
exactly on whole shingle sets. Only links that hold leave that check, one a member, so rows grow with the members of a
family and not with its pairs; families larger than BLOCK are checked as pairs of blocks.

Cases: null and empty texts have fingerprint zero and link like any other. Texts of any length are read whole, RUN
shingles at a time. Repeated rows have equal fingerprints and are one entry of the index; a bit that exactly half of
the hashes have is 0; an empty table gives an empty table. near_duplicates looks at doc_id and text alone, so other
columns clash with nothing; deduplicated passes all columns and takes working names that none of them has. Only
fingerprints, never texts, are shuffled to find links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import cut, fresh
from .components import connected_components

SEED = 42
#: Shingles hashed at once.
RUN = 1 << 16
#: The bits of a byte as eight counters of a byte each; up to 255 of them add up without a carry.
_LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], dtype="<u8")


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A further hash from a hash (splitmix64's finaliser); word 0 is the hash itself."""
    if word:
        h = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def _shingles(parts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, RUN at a time."""
    n = max(1, len(parts) - width + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = (np.concatenate([[0], ends[:-1] + 1])[:n]).tolist()
    ends = (ends[width - 1 :] if len(parts) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + RUN], ends[at : at + RUN], strict=True)], dtype="<u8")


def _words(text: str | None) -> list[bytes]:
    """A-Z are lower-cased; words are split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, width: int = 3, words: int = 1, once: bool = False) -> list[int]:
    """The fingerprint's words, unsigned. once: a repeated shingle counts once."""
    parts = _words(text)
    if not parts:
        return [0] * words
    ones, n = np.zeros(words * 64, dtype=np.int64), 0
    runs = _shingles(parts, width)
    for h in [np.unique(np.concatenate(list(runs)))] if once else runs:
        n += len(h)
        for at in range(0, len(h), 255):
            some = h[at : at + 255]
            bytes_ = np.stack([_mixed(some, k) for k in range(words)], axis=1).view(np.uint8)
            ones += _LANES[bytes_].sum(axis=0, dtype="<u8").view(np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8").tolist()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The 32-bit hashes of the set of shingles, sorted; none for an empty text."""
    parts = _words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint32)
    return np.unique(np.concatenate([(h >> np.uint64(32)).astype(np.uint32) for h in _shingles(parts, width)]))


def anchors(shingles: np.ndarray) -> np.ndarray:
    """For each segment a hash of two min-wise hashes of the shingle set."""
    low = np.full(2 * SEGMENTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[at : at + 2048, None].astype(np.uint64) ^ _XOR) * _TIMES).min(axis=0))
    return _mixed(_mixed(low[::2], 2) ^ low[1::2], 3)


def variants(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The keys of texts, a row each: every segment with one bit blanked in turn, beside a hash of its number and its anchor.

    bits: (texts, WORDS) unsigned, anchor: (texts, SEGMENTS). Equal segments agree in all variants, segments that differ
    by one bit in one, others in none. The low VARIANT bits are the variant and its value, those above the hash.
    """
    segments = np.ascontiguousarray(bits).view(np.uint8)[:, :SEGMENTS, None]
    blanks = np.arange(SEGMENT, dtype=np.uint8)
    kept = (segments & ~(np.uint8(1) << blanks)).astype(np.uint64) | blanks.astype(np.uint64) << np.uint64(SEGMENT)
    place = _mixed(anchor + np.arange(SEGMENTS, dtype=np.uint64), 1) >> np.uint64(VARIANT) << np.uint64(VARIANT)
    return (place[:, :, None] | kept).reshape(len(bits), KEYS)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, w0, w1, ...): the words as signed longs."""
    return _prints(docs, words, lambda t: (fingerprint(t, width, words),))


def _prints(docs: DataFrame, words: int, of: Callable[[str | None], tuple], *more: str) -> DataFrame:
    """(doc_id, w0, ..., and the named binary columns) of what a text gives: the words first."""
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [of(t) for t in part.column("text").to_pylist()]
            found = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            extra = [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, len(more) + 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, k]) for k in range(words)), *extra], ["doc_id", *names, *more])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(["doc_id bigint", *(f"{n} bigint" for n in names), *(f"{n} binary" for n in more)]))


def _joined(words: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows within limit bits of each other, directly or through others."""
    left = np.arange(len(words))
    links = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(words[left] ^ words[at]).sum(axis=1) <= limit
            found = left[near].tolist()
            links += [(at, x) for x in found]
            queue += found
            left = left[~near]
    return links


def bucket_links(keys: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Links between rows of equal key (sorted), as pairs of row numbers."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.repeat(starts, sizes)
    near = np.bitwise_count(words ^ words[first]).sum(axis=1) <= limit  # each row against the first of its bucket
    away = np.add.reduceat(~near, starts)
    rows = np.flatnonzero(near & (first != np.arange(len(keys))))
    out = [np.column_stack([first[rows], rows])]
    # Rows away from the first: a bucket with one such row and nobody else is done; the others are searched.
    for b in np.flatnonzero((away > 0) & (sizes > 2)).tolist():
        s = slice(starts[b], starts[b] + sizes[b])
        if found := _joined(words[s], limit):
            out.append(np.array(found) + starts[b])
    return np.concatenate(out)


def bucket_roots(keys: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Pairs (first row of its component, row) for all rows that bucket_links joins to an earlier one."""
    found = bucket_links(keys, words, limit)
    root = np.arange(len(keys))
    root[found[:, 1]] = found[:, 0]
    while not np.array_equal(up := root[root], root):
        root = up
    rows = np.flatnonzero(root != np.arange(len(keys)))
    return np.column_stack([root[rows], rows])


def _by_bucket(index: DataFrame, pairs_of: Callable[[np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """Edges (a, b), a < b, of w0 values from the pairs of row numbers that pairs_of finds in whole buckets.

    index: (key, w0, ...), longs, dealt and sorted by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on in the next batch
        seen: set[tuple[int, int]] = set()

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for pairs in pairs_of(rows):
                ends = np.unique(np.sort(rows[:, 1][pairs], axis=1), axis=0)
                fresh = [p for p in map(tuple, ends.tolist()) if p not in seen]
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(fresh)
                if fresh:
                    a, b = zip(*fresh, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64, copy=False)
            if not len(rows):
                continue
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last == 0 and held and held[0][0, 0] == rows[0, 0]:
                held.append(rows)
                continue
            if held or last:
                yield from found(np.concatenate([*held, rows[:last]]))
            held = [rows[last:]]
        if held:
            yield from found(np.concatenate(held))

    return index.mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, segments: int, segment_bits: int, limit: int, words: int = 1) -> DataFrame:
    """Edges (a, b) between w0 values that connect all nodes which share a key and differ by at most limit bits.

    nodes: distinct (w0, w1, ...), as many words as the segments need. Two nodes meet if one of the segments differs
    by at most one bit; the bits of the first `words` words are then compared.
    """
    names = [f"w{k}" for k in range(words)]
    mask = (1 << segment_bits) - 1
    def variants(segment: int, value: Column) -> Column:
        """Keys of a segment: segment number, variant and value. Variant 0 is the value, variant i has bit i - 1 blanked."""

        def key(i: Column) -> Column:
            blank = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1))
            return F.when(i == 0, value).otherwise(value.bitwiseAND(blank)) + (F.lit(segment * 64).cast("bigint") + i) * F.lit(1 << segment_bits).cast("bigint")

        return F.transform(F.sequence(F.lit(0), F.lit(segment_bits)), key)

    keys = []
    for s in range(segments):
        word, shift = divmod(s * segment_bits, 64)
        value = F.shiftrightunsigned(F.col(f"w{word}"), shift)
        if shift + segment_bits > 64:  # a segment across two words
            value = value.bitwiseOR(F.shiftleft(F.col(f"w{word + 1}"), 64 - shift))
        keys.append(variants(s, value.bitwiseAND(F.lit(mask).cast("bigint"))))
    # Dealt anew: the few rows become many, so they must not sit in as few tasks as they would fill.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.repartition(parts, "w0").select(F.explode(F.concat(*keys)).alias("key"), *names)
    # In a bucket the order is hashed with the key: the same in every run, but another first row in other buckets.
    index = index.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "w0"))

    return _by_bucket(index, lambda rows: iter([bucket_links(rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64), limit)]))


def groups(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(w0, component_id) from classes (w0, least) and edges (a, b): the smallest id of each class's component."""
    found = connected_components(edges)
    linked = classes.select("w0", "least").join(found, F.col("w0") == F.col("node")).select("w0", "root", "least")
    lows = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("w0", "root").join(lows, "root").select(F.col("w0").alias("node"), "component_id")
    return classes.join(linked, F.col("w0") == F.col("node"), "left").select(F.col("w0").alias("of"), F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): 3-word shingles, 64 bits, links at 2 or fewer differing bits, exactly.

    Two segments of 32 bits: of two differing bits or fewer, one segment has one at most, so no link is missed.
    """
    prints = cut(fingerprints(docs))
    classes = prints.groupBy("w0").agg(F.min("doc_id").alias("least"))
    # A written table: the join below then has an exchange on both sides, and a hot fingerprint can be split.
    found = cut(groups(classes, links(classes.select("w0"), segments=2, segment_bits=32, limit=2)))
    hexed = F.lower(F.lpad(F.hex("w0"), 16, "0"))
    return prints.join(found, F.col("w0") == F.col("of")).select("doc_id", hexed.alias("fingerprint"), "component_id")


#: What deduplication uses: two texts are alike at SIMILARITY or more of their five-word shingles. To find them,
#: SEGMENTS segments of 8 bits of a 128-bit fingerprint of three-word shingles (an edit disturbs fewer of those) are
#: indexed with one bit blanked in turn, each together with two min-wise hashes of the five-word shingles: equal keys
#: need a common text, so buckets do not fill up as the corpus grows, however short the segments are. At 0.8 a bit
#: differs with a probability of 0.152 even if the edit is one block (scattered edits: less), so a segment has one
#: differing bit at most with 0.848 ** 8 + 8 * 0.152 * 0.848 ** 7 = 0.651, and a pair meets with
#: 1 - (1 - 0.8 ** 2 * 0.651) ** 12 = 0.998. Pairs that meet are checked if they differ by at most NEAR bits or are
#: joined by others that do: four standard deviations above what a pair at 0.8 differs by.
SIMILARITY, WIDTH, CANDIDATE_WIDTH = 0.8, 5, 3
WORDS, SEGMENT, SEGMENTS, NEAR = 2, 8, 12, 36
KEYS, VARIANT = SEGMENTS * SEGMENT, 11
_TIMES, _XOR = (np.random.default_rng([SEED, k]).integers(0, 1 << 63, 2 * SEGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 2))
#: Bytes of shingle sets in a block of a family, each member counted MEMBER bytes more; a worker holds two blocks.
BLOCK, MEMBER = 4 << 20, 1024


def meetings(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, of w0 values of nodes (w0, bits, anchors): a is the least of a bucket's members that NEAR bits join to b."""
    names = ["key", "w0", *(f"b{k}" for k in range(WORDS))]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype="<u8").reshape(-1, WORDS)
                anchor = np.frombuffer(b"".join(part.column("anchors").to_pylist()), dtype="<u8").reshape(-1, SEGMENTS)
                rest = [part.column("w0").to_numpy(), *bits.view("<i8").T]
                yield pa.RecordBatch.from_arrays([pa.array(variants(bits, anchor).ravel().view("<i8")), *(pa.array(np.repeat(c, KEYS)) for c in rest)], names)

    index = nodes.mapInArrow(expand, ", ".join(f"{n} bigint" for n in names))
    # The variants of a segment are dealt to one task, so what meets in several of them is one edge. The same order in
    # all buckets: those of one family have few first rows among them.
    index = index.repartition(F.shiftright("key", VARIANT)).sortWithinPartitions("key", "w0")
    return _by_bucket(index, lambda rows: iter([bucket_roots(rows[:, 0], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), NEAR)]))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def alike_rows(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows whose sets are alike, directly or through others; each link is alike, exactly.

    Sets that are alike share one of their rarest members: with all members in one order, rare ones first, each has
    one among its first len - ceil(similarity * len) + 1 in common with the other's. Whole sets of such pairs are
    compared, and a row that was reached is not searched for again.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sets)), sizes)
    members = rank[at]
    members = members[np.lexsort((members, owner))]  # within each set by rank
    firsts = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
    head = _spans(starts, firsts)
    order = np.argsort(members[head], kind="stable")
    listed, rows = members[head][order], owner[head][order]  # which rows have a member among their first
    begins = np.searchsorted(listed, np.arange(len(counts)))
    lengths = np.diff(np.append(begins, len(listed)))
    left, has, links = np.ones(len(sets), dtype=bool), np.zeros(len(counts), dtype=bool), []
    for row in range(len(sets)):
        queue = [row] if left[row] else []
        left[row] = False
        while queue:
            i = queue.pop()
            mine = members[starts[i] : starts[i] + sizes[i]]
            own = mine[: firsts[i]]
            near = np.zeros(len(sets), dtype=bool)
            near[rows[_spans(begins[own], lengths[own])]] = True
            near = np.flatnonzero(near & left & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9))
            if not len(near):
                continue
            has[mine] = True
            common = np.add.reduceat(has[members[_spans(starts[near], sizes[near])]], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            has[mine] = False
            found = near[common / (sizes[near] + sizes[i] - common) >= similarity]
            left[found] = False
            links += [(i, x) for x in found.tolist()]
            queue += found.tolist()
    return links


def alike_links(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) between alike classes (w0, bits, anchors, weight) that connect all which meet and are alike.

    A family is a class with all that meet it as the least of a bucket; any two that meet are in one family. Its whole
    sets come together and only links that hold leave. A family of more than BLOCK is dealt as pairs of blocks, so each
    two members still meet and no worker holds more than two blocks.
    """
    met = cut(meetings(classes.select("w0", "bits", "anchors")).distinct())
    members = met.select(F.col("a").alias("family"), F.col("b").alias("w0")).union(met.select("a", "a").distinct())
    members = cut(members.join(classes.select("w0", "weight"), "w0"))
    blocks = members.groupBy("family").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    members = members.join(blocks, "family", "left").select("w0", "family", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("w0"), F.col("blocks")).cast("int").alias("own")
    members = members.select("w0", "family", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("w0", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("place"))
    sets = prints.select("w0", "shingles").join(met.select(F.col("a").alias("w0")).union(met.select("b")).distinct(), "w0", "left_semi")
    dealt = members.join(sets.groupBy("w0").agg(F.min("shingles").alias("shingles")), "w0").select("place", "w0", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        place = None

        def found() -> Iterator[pa.RecordBatch]:
            if links := alike_rows([np.frombuffer(x, np.uint32) for _, x in held]) if len(held) > 1 else []:
                a, b = np.sort(np.array([w for w, _ in held])[np.array(links)], axis=1).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for p, w, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if p != place:
                        yield from found()
                        held, place = [], p
                    held.append((w, x))
        yield from found()

    return dealt.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a bigint, b bigint")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Texts of equal words are one class, named by 64 bits of XXH64 of them. Rows that repeat both id and text stay as one
    row. Rows without a doc_id are not judged: all of them stay. Of a doc_id with several texts, all stay if one does.
    """

    def of(text: str | None) -> tuple:
        words, shingles = fingerprint(text, CANDIDATE_WIDTH, WORDS, once=True), shingle_set(text, WIDTH)
        same = xxhash.xxh64_intdigest(b" ".join(_words(text)), SEED)
        return [same], np.array(words, dtype="<u8").tobytes(), anchors(shingles).tobytes(), shingles.tobytes()

    prints = cut(_prints(docs.filter("doc_id IS NOT NULL"), 1, of, "bits", "anchors", "shingles"))
    least = lambda of: F.min(of).alias(of)
    classes = cut(prints.groupBy("w0").agg(F.min("doc_id").alias("least"), least("bits"), least("anchors"), F.min(F.length("shingles") + MEMBER).alias("weight")))
    found = cut(groups(classes.select("w0", "least"), alike_links(classes, prints)))
    kept = prints.select("doc_id", "w0").join(found, F.col("w0") == F.col("of")).filter(F.col("doc_id") == F.col("component_id"))
    id_, n = fresh(docs.columns, "id"), fresh(docs.columns, "n")
    kept = cut(kept.groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(n)))
    chosen = lambda which: docs.join(kept.filter(which), docs["doc_id"] == F.col(id_), "left_semi")
    out = chosen(F.col(n) == 1).unionByName(docs.filter("doc_id IS NULL"))
    several = kept.filter(F.col(n) > 1)
    return out if several.isEmpty() else out.unionByName(chosen(F.col(n) > 1).dropDuplicates(["doc_id", "text"]))
