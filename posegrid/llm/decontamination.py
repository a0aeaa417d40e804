"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is searched for every benchmark item. Items are partitioned by the size
of their shingle set, in powers of two. For the partition up to 2^j shingles the
document's run of shingles is cut into blocks of 2^j; any two adjacent blocks form
a window, so wherever an item stands, one window of at most twice its partition's size
covers it. Minima of hash functions are kept per block and merge by minimum, from
the smallest partition's blocks to the larger ones' and to windows. The window's
size bounds its Jaccard similarity with an item it contains, so a containment
threshold becomes a number of hash functions: an item is a candidate if it shares
any of `FUNCTIONS` minima with a window. At a containment of 0.8 the similarity is
at least 0.19, and an item in one stretch is missed with a probability of 1e-6 at
the most. Candidates are confirmed by counting the item's shingles in the whole
document, on the words themselves.

Items come in blocks of bounded size. The driver indexes each block once and sends
the index to the workers, which keep it from task to task; each block is one pass
over the documents, without a shuffle, so neither table needs to fit anywhere.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
text with A-Z lower-cased. Defined results: null texts, and texts without words,
contain nothing and are contained in nothing; an item or document of fewer than
`width` words has its whole word sequence as its one shingle, so such an item is
found only in a document of the same words; repeated items and rows give repeated
results; rows with null ids take part under the null id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, tidy
from .shingles import multipliers, shingles, word_bytes, words

FUNCTIONS = 64
#: Shingles of the benchmark that one pass may hold.
PASS_SHINGLES = 2_000_000
BATCH_BYTES, SLICE = 1 << 20, 1 << 15
_WORD = word_bytes(True)
#: Tell the functions' minima apart; leading bits by which most windows are ruled out.
_TAGS, _SHIFT = multipliers(FUNCTIONS, 307), 44
_A, _B = multipliers(FUNCTIONS, 101), multipliers(FUNCTIONS, 211)
_FIND = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_list(text: str | None) -> list[str]:
    return _FIND.findall((text or "").translate(_LOWER))


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    """The exact shingle set of a text."""
    w = word_list(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width))))


def _minima(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Minimum of each hash function in each run that begins at the cuts, (functions, runs)."""
    out = np.full((FUNCTIONS, len(cuts)), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), SLICE):
        part = hashes[a : a + SLICE]
        first = int(np.searchsorted(cuts, a, side="right")) - 1
        last = int(np.searchsorted(cuts, a + len(part), side="left"))
        at = np.maximum(cuts[first:last] - a, 0)
        buffer = np.empty_like(part)
        for k in range(FUNCTIONS):
            np.multiply(part, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            np.minimum(out[k, first:last], np.minimum.reduceat(buffer, at), out=out[k, first:last])
    return out


class Index:
    """The minima of a block of items, by size partition; made on the driver, sent as arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.width = width
        self.items = [(i, t) for i, t in items if word_list(t)]
        data, offsets = text_bytes(pa.array([t for _, t in self.items], type=pa.string()))
        hashes, starts = words(data, offsets, _WORD)
        runs, bounds = shingles(hashes, starts, width)
        by_level: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k in range(len(self.items)):
            own = runs[bounds[k] : bounds[k + 1]]
            by_level[max(len(np.unique(own)) - 1, 0).bit_length()].append((own, k))
        self.levels = sorted(by_level)
        self.minima: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for level, members in by_level.items():
            least = _minima(np.concatenate([m for m, _ in members]), np.concatenate([[0], np.cumsum([len(m) for m, _ in members])[:-1]]))
            keys = (least ^ _TAGS[:, None]).reshape(-1)  # a minimum counts for its own function only
            owners = np.tile(np.array([k for _, k in members]), FUNCTIONS)
            order = np.argsort(keys, kind="stable")
            self.minima[level] = keys[order], owners[order]
        self._local()

    def _local(self) -> None:
        """What each process makes for itself."""
        self.keys = {level: (keys, owners, _sieve(keys)) for level, (keys, owners) in self.minima.items()}
        self._sets: dict[int, set[tuple[str, ...]]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "_sets")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._local()

    def shingles(self, k: int) -> set[tuple[str, ...]]:
        """The shingle set of an item, made when it is first a candidate."""
        if k not in self._sets:
            self._sets[k] = shingle_set(self.items[k][1], self.width)
        return self._sets[k]

    def contained(self, col: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its set size, shared shingles) for a column of texts."""
        data, offsets = text_bytes(col)
        for a, b in slices(offsets, BATCH_BYTES):
            hashes, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _WORD)
            runs, bounds = shingles(hashes, starts, self.width)
            for d, those in self.candidates(runs, bounds).items():
                own = shingle_set(col[a + d].as_py(), self.width)
                for k in sorted(those):
                    shared = len(self.shingles(k) & own)
                    if 100 * shared >= percent * len(self.shingles(k)):
                        yield a + d, k, len(self.shingles(k)), shared

    def candidates(self, runs: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """Items that share a minimum with a window of each text."""
        found: dict[int, set[int]] = defaultdict(set)
        if not self.levels or not len(runs):
            return found
        level = self.levels[0]
        counts = np.diff(bounds)
        blocks = -(-counts // (1 << level))
        first = np.concatenate([[0], np.cumsum(blocks)])
        of = np.repeat(np.arange(len(counts)), blocks)
        cuts = bounds[:-1][of] + (np.arange(first[-1]) - first[:-1][of]) * (1 << level)
        least = _minima(runs, cuts)
        for wanted in range(level, self.levels[-1] + 1):
            if wanted > level:  # pairs of blocks become blocks of twice the size
                place = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
                even = np.flatnonzero(place % 2 == 0)
                least = np.minimum.reduceat(least, even, axis=1) if len(even) else least
                blocks = -(-blocks // 2)
                first = np.concatenate([[0], np.cumsum(blocks)])
            if wanted not in self.keys:
                continue
            keys, owners, sieve = self.keys[wanted]
            of = np.repeat(np.arange(len(counts)), blocks)
            window = least.copy()
            inner = np.flatnonzero(of[1:] == of[:-1])
            window[:, inner] = np.minimum(least[:, inner], least[:, inner + 1])
            window ^= _TAGS[:, None]
            f, w = np.nonzero(sieve[(window >> np.uint64(_SHIFT)).astype(np.int64)])
            if len(f):
                hit = window[f, w]
                low, high = np.searchsorted(keys, hit, side="left"), np.searchsorted(keys, hit, side="right")
                for k in np.flatnonzero(high > low):
                    found[int(of[w[k]])].update(owners[low[k] : high[k]].tolist())
        return found


def _sieve(keys: np.ndarray) -> np.ndarray:
    """Which leading bits occur among the keys."""
    out = np.zeros(1 << (64 - _SHIFT), dtype=bool)
    out[(keys >> np.uint64(_SHIFT)).astype(np.int64)] = True
    return out


def _search(df: DataFrame, items: list[tuple[int | None, str | None]], width: int, percent: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Index(items, width))  # bounded by PASS_SHINGLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [(batch.column("doc_id")[d].as_py(), index.items[k][0], n, c, c / n) for d, k, n, c in index.contained(batch.column("text"), percent)]
            if rows:
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return df.mapInArrow(tidy(run), "doc_id long, item_id long, n_item long, n_shared long, containment double")


def _without(df: DataFrame, items: list[tuple[int | None, str | None]], width: int, percent: int, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Index(items, width))  # bounded by PASS_SHINGLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for d, *_ in index.contained(batch.column(text), percent):
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(tidy(run), df.schema)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of at most PASS_SHINGLES words, or one item."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(word_list(r["text"]))
        if block and size + n > PASS_SHINGLES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def containments(
    docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) of at least `percent` per cent containment."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    parts = [_search(docs, block, width, percent) for block in _item_blocks(items)] or [_search(docs, [], width, percent)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item; each row is judged by its own text."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    for block in _item_blocks(items):
        docs = _without(docs, block, width, percent, text)
    return docs
