"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary (pieces that start a word, pieces that continue one) is a trie with two roots. Every node has a
failure link and the number of tokens that taking it pops, computed once breadth-first (Song et al., Fast
WordPiece Tokenization, 2021). Reading a word then follows one edge or link at a time, and adds the popped
counts: the number of greedy longest-match pieces comes out in time linear in the word, and no piece is built.
A word that cannot be cut into pieces is one unknown token, as in WordPiece.

Words are maximal runs of letters, digits and underscores; any other character but white space is a word of its
own. A Python worker builds the default automaton once, for all its tasks.

Cases: a null or empty text has no words. Words and texts of any length are read whole. Greedy matching has no ties.
Repeated rows are counted alike, row by row; an empty table gives an empty table. Only doc_id and text of the input are
looked at, so other columns clash with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import worker_memory

WORD = re.compile(r"\w+|[^\w\s]")
#: Words that a worker remembers; emptied when full. Longer words than LONG are not kept.
CACHE, LONG = 1 << 18, 64
_UNKNOWN = 1 << 40


def default_vocabulary() -> tuple[list[str], list[str]]:
    """Starting and continuing pieces of the public 32k piece vocabulary (a leading mark means the start)."""
    import public_tokenizers
    import sentencepiece

    return split_vocabulary(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")))


def split_vocabulary(model) -> tuple[list[str], list[str]]:
    usual = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in usual if p[0] == "▁" and p.strip("▁") == p[1:] and p[1:]], [p for p in usual if "▁" not in p]


class Matcher:
    """The automaton. tokens(word) is the piece count, or None where the word has no cut into pieces."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: word start, node 1: continuation
        piece = [False, False]
        for root, vocabulary in ((0, starts), (1, continues)):
            for text in vocabulary:
                node = root
                for c in text:
                    node = self.edges[node].setdefault(c, len(self.edges))
                    if node == len(self.edges):
                        self.edges.append({})
                        piece.append(False)
                piece[node] = bool(text)
        self.link = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        level = [0, 1]
        while level:
            after = []
            for u in level:
                for c, v in self.edges[u].items():
                    after.append(v)
                    if piece[v]:
                        self.link[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.edges[z][c], popped
            level = after

    def tokens(self, word: str) -> int | None:
        edges, link, pops = self.edges, self.link, self.pops
        node = n = 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return None
            node = to
        while node > 1:  # the end of the word: pop what is left
            n += pops[node]
            node = link[node]
        return n if node == 1 or not word else None


class _Known(dict):
    """Word -> its tokens, plus _UNKNOWN for an unknown word."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        n = self.matcher.tokens(word)
        value = 1 + _UNKNOWN if n is None else n
        if len(word) <= LONG:
            self[word] = value
        return value


def _default_words() -> _Known:
    """The words of the default vocabulary that this Python process has seen; built once in it."""
    memory = worker_memory()
    if "words" not in memory:
        memory["words"] = _Known(Matcher(*default_vocabulary()))
    return memory["words"]


SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


def token_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """One row per document: words, tokens and how many of the tokens are unknown words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Matcher(*vocabulary)) if vocabulary else _default_words()
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                words = WORD.findall(text or "")
                total = sum(map(known.__getitem__, words))
                rows.append((len(words), total % _UNKNOWN, total // _UNKNOWN))
                if len(known) >= CACHE:
                    known.clear()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
