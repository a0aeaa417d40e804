"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A token sequence is the merge result of its text exactly when every two adjacent
tokens are what the merge procedure makes of their joined text. So the encoder
takes longest vocabulary matches (Aho-Corasick), checks each new token against
its left neighbour by re-merging the two, and on a clash goes to the next shorter
match or steps back; a bitfield remembers end positions that lead nowhere.

Text is first cut where no vocabulary piece can reach across (before a space
mark, around characters without a piece, between a Latin letter and a
punctuation mark that no piece joins), and results of such segments are kept in a
bounded table per worker process.

Defined results: null text encodes as the empty text, which has no ids; null ids
decode to null; any length is encoded whole; other columns pass through, and a
column that already has the output's name is replaced.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_bytes, tidy

SPACE = "▁"
#: Piece kinds of the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Latin letters, within which segments are looked up as words.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Segments and pairs a worker process keeps before it starts afresh.
KEPT_SEGMENTS, KEPT_PAIRS = 100_000, 250_000
BATCH_BYTES = 4 << 20

codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message, unparsed."""
    i, n = 0, len(data)

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, data[i : i + size]
            i += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<d" if size == 8 else "<f", data[i : i + size])[0]
            i += size


class Model:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only BPE models with identity normalisation and kept white space are supported")
        kinds = {k for _, _, k in pieces}
        if kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("user-defined or unused pieces, or no byte pieces, are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.sizes = [len(p) for p, _, _ in pieces]
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        letter = re.compile(f"[{LATIN}]")
        apart = set(map(chr, range(33, 127))) - {c for p in self.ids for a, c in zip(p, p[1:]) if letter.match(a)}
        apart = {c for c in apart if not letter.match(c)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or "\n" in "".join(self.ids):
            raise ValueError("pieces across word starts or lines are not supported")
        stop = "".join(map(re.escape, sorted(apart)))
        self.cut = re.compile(f"{SPACE}*[{LATIN}]+(?=[{stop}{SPACE}\n]|\\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.pairs: dict[int, bool] = {}
        #: What each id adds to a decoded text; control and unknown pieces add nothing or the library's mark.
        self.raw = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, k in pieces
        ]

    def merge(self, text: str) -> list[str]:
        """The plain merge procedure: always the best-scored adjacent pair, leftmost on a tie."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: re-merging their text gives the two again; a = -1: whether merges make b at all."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        x = [self.pieces[a][0]] if a >= 0 else []
        y = [self.pieces[b][0]]
        found = self.pairs[a << 20 | b] = self.merge("".join(x + y)) == x + y
        return found

    def known(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces, by backtracking.

        A piece that no merge makes never stands first or fits a neighbour, so it drops out by itself.
        """
        n, sizes, pairs = len(text), self.sizes, self.pairs
        at: list[list[int]] = [[] for _ in range(n)]
        for start, i in [(end + 1 - sizes[i], i) for end, i in self.automaton.iter(text)]:
            at[start].append(i)  # shorter matches come first
        out: list[int] = []
        picks: list[int] = []  # where each chosen token stands in its position's matches
        failed, pos, last = 0, 0, -1
        here = at[0]
        pick = len(here) - 1
        while True:
            while pick >= 0:
                i = here[pick]
                end = pos + sizes[i]
                if not failed >> end & 1:
                    ok = pairs.get(last << 20 | i)
                    if self.fits(last, i) if ok is None else ok:
                        break
                pick -= 1
            if pick >= 0:
                out.append(i)
                if end == n:
                    return out
                picks.append(pick)
                last, pos, here = i, end, at[end]
                pick = len(here) - 1
            else:
                failed |= 1 << pos
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                pos -= sizes[out.pop()]
                last, here, pick = out[-1] if out else -1, at[pos], picks.pop() - 1

    def segment(self, text: str) -> list[int]:
        """Ids of a segment; a character without a piece becomes byte pieces."""
        ids = self.ids
        if self.chars.issuperset(text):
            return self.known(text)
        out, run = [], ""
        for c in text:
            if c in ids:
                run += c
            else:
                out += self.known(run) if run else []
                run = ""
                out += [self.bytes[b] for b in c.encode()]
        return out + (self.known(run) if run else [])

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment(s)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the first space mark is dropped, each byte that is no UTF-8 becomes U+FFFD."""
        raw = self.raw
        data = b"".join(map(raw.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            for i in ids:
                if raw[i]:
                    return (data[1:] if self.pieces[i][2] == NORMAL else data).decode("utf-8", "each_byte")
        return data.decode("utf-8", "each_byte")


class _Kept(dict):
    """Packed int32 ids of segments: two generations, of which the older goes when the newer is full."""

    def __init__(self, model: Model):
        self.model = model
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = array("i", self.model.segment(text)).tobytes()
        if len(text) <= 64:
            if len(self) >= KEPT_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[text] = packed
        return packed


_LOADED: dict[bytes, tuple[Model, _Kept]] = {}


def _loaded(data: bytes) -> tuple[Model, _Kept]:
    """Model and segment table of this worker process."""
    if data not in _LOADED:
        _LOADED.clear()
        model = Model(data)
        _LOADED[data] = model, _Kept(model)
    return _LOADED[data]


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of a text column, and their decoded text if `decoded` names a column for it.

    `model` is the model file's path on the driver. Decoding along the way needs one
    worker process a core instead of two.
    """
    data = df.sparkSession.sparkContext.broadcast(model_bytes(model))  # a vocabulary, half a MB
    schema = _with(df.schema, ids, T.ArrayType(T.IntegerType()))
    schema = _with(schema, decoded, T.StringType()) if decoded else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, kept = _loaded(data.value)
        for batch in by_bytes(batches, text, BATCH_BYTES):
            packed = [b"".join(map(kept.__getitem__, net.segments(t or ""))) for t in batch.column(text).to_pylist()]
            out = _put(batch, ids, _lists(packed))
            if decoded:
                out = _put(out, decoded, pa.array([net.decode(np.frombuffer(p, dtype=np.int32).tolist()) for p in packed], type=pa.string()))
            yield out
        kept.clear()  # the next partition has other rare words, and a waiting worker needs no table
        kept.older = {}

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids have none."""
    data = df.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, _ = _loaded(data.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [None if x is None else net.decode(x) for x in part.column(ids).to_pylist()]
                yield _put(part, text, pa.array(texts, type=pa.string()))

    return df.mapInArrow(tidy(run), _with(df.schema, text, T.StringType()))
