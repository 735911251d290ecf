"""Encoding and decoding with a SentencePiece BPE model by a table of last tokens.

For every prefix of a text there is exactly one token that can end its encoding. An Aho-Corasick automaton over
the pieces gives, at each position, the pieces that end there; the last token is the one that is compatible with
the last token of the prefix before it. Two pieces are compatible if merging their joined text alone gives back
exactly the two; this is remembered for each pair. The ids are then read backwards from the end. The work is
linear in the text, whatever its length.

A text is cut before every run of space marks: no piece has a mark after another character (checked when the
model is loaded), so no merge crosses such a cut. Characters outside the vocabulary become the byte pieces of
their UTF-8. Decoding joins the pieces, turns marks into spaces, runs of byte pieces into text (a byte that is
not UTF-8 becomes U+FFFD), and removes the one mark that encoding put in front.

Models supported: BPE, byte fallback, identity normalisation, a dummy prefix, spaces kept and escaped; others are
refused. A Python worker loads the model once and remembers units and pairs of pieces across its tasks, within CACHE.

Cases: null and empty texts have no ids. Very long texts are encoded whole, and a unit of any length in linear work.
Repeated rows are encoded alike, row by row; of pairs of equal score the leftmost is joined first. An empty table
gives an empty table. Only doc_id and text (or ids) of the input are looked at, so other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import worker_memory

MARK = "▁"
#: Entries of each memory in a worker; it is emptied when full.
CACHE = 1 << 18
_INF = float("inf")
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceCodec:
    """A loaded model: encode(text) and decode(ids) as the sentencepiece library does them."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            top = [(k, dict(_fields(v))) for k, v in _fields(f.read()) if k in (2, 3)]
        # Fixed values of the model format: trainer_spec 2 (model_type 3: BPE is 2; byte_fallback 35);
        # normalizer_spec 3 (charsmap 2, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
        trainer, norm = (next((v for k, v in top if k == n), {}) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = {i for i in range(len(self.pieces)) if sp.is_unknown(i)}
        special = self.control | self.unknown | self.bytes.keys()
        if any(sp.is_unused(i) for i in range(len(self.pieces))):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if MARK not in self.ids or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces with a space mark after another character are not supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._plain = frozenset(special)
        self.text = [p.replace(MARK, " ") for p in self.pieces]
        self.size = [len(p) for p in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self._pairs: dict[int, bool] = {}
        self._units: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair of the best score, the leftmost of equals, until none is left."""
        score = self.score.get
        parts = list(text)
        # The score of each part joined to the next; a join changes two of them.
        joins = [score(a + b, -_INF) for a, b in zip(parts, parts[1:], strict=False)]
        while joins:
            best = max(joins)
            if best == -_INF:
                break
            at = joins.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = score(parts[at - 1] + parts[at], -_INF)
            if at < len(joins):
                joins[at] = score(parts[at] + parts[at + 1], -_INF)
        return parts

    def _test(self, pair: int) -> bool:
        """Whether the last two tokens, before * 2 ** 20 + after, are compatible; before 0: after stands alone."""
        if len(self._pairs) >= CACHE:
            self._pairs.clear()
        parts = [self.pieces[i] for i in divmod(pair, 1 << 20) if i]
        known = self._pairs[pair] = self.merge("".join(parts)) == parts
        return known

    def unit_ids(self, unit: str) -> list[int]:
        """The encoding of a text without cuts; characters outside the vocabulary stand alone, as bytes."""
        # last[i]: the token that ends with character i; 0: the character is not in the vocabulary. The place after
        # the end stays 0 and stands, as last[-1], before the start: nothing to be compatible with, as after such a character.
        last = [0] * (len(unit) + 1)
        known = self._pairs.get
        for end, (token, size) in self.automaton.iter(unit):  # at one end the longest comes first
            if last[end]:
                continue
            pair = (last[end - size] << 20) + token
            fits = known(pair)
            if self._test(pair) if fits is None else fits:
                last[end] = token
        out, at = [], len(unit) - 1
        while at >= 0:
            token = last[at]
            if token:
                out.append(token)
                at -= self.size[token]
            else:
                out += [self.byte_ids[b] for b in reversed(unit[at].encode())]
                at -= 1
        out.reverse()
        return out

    def units(self, text: str | None) -> list[str]:
        return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.units(text) for i in self.unit_ids(u)]

    def _surface(self, ids: list[int]) -> str:
        if self._plain.isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out, run = [], bytearray()

        def flush() -> None:
            if run:
                at = 0
                while at < len(run):  # whole characters, else one replacement for each byte
                    for n in (1, 2, 3, 4):
                        try:
                            out.append(bytes(run[at : at + n]).decode())
                            at += n
                            break
                        except UnicodeDecodeError:
                            pass
                    else:
                        out.append("�")
                        at += 1
                run.clear()

        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            flush()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.text[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first not in self.bytes and first not in self.unknown and self.pieces[first].startswith(MARK) else text

    def _unit(self, unit: str) -> tuple[str, int, str]:
        entry = self._older.get(unit)
        if entry is None:
            own = self.unit_ids(unit)
            entry = ",".join([self.decimal[i] for i in own]), len(own), self._surface(own)
        if len(unit) <= 64:
            if len(self._units) >= CACHE // 2:
                self._older, self._units = self._units, {}
            self._units[unit] = entry
        return entry

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        found = []
        for u in self.units(text):
            found.append(self._units.get(u) or self._unit(u))
        if not found:
            return 0, "", ""
        ids, n, decoded = zip(*found, strict=True)
        return sum(n), ",".join(ids), "".join(decoded)[1:]  # every unit starts with a mark


def codec_of(path: str) -> PieceCodec:
    """The codec of a model file: one in each Python process, with what it remembers of earlier tasks."""
    codecs = worker_memory().setdefault("codecs", {})
    if path not in codecs:
        codecs.clear()
        codecs[path] = PieceCodec(path)
    return codecs[path]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row per document: id count and SHA-256 of the id list and of the decoded text."""
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in slices(batches):
            rows = [(n, sha(i), sha(d)) for n, i, d in map(codec.digest, part.column("text").to_pylist())]
            n, i, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the encoding itself."""
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for part in slices(batches):
            ids = [codec.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids: null text."""
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for part in slices(batches, "ids"):
            texts = [None if i is None else codec.decode(i) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
