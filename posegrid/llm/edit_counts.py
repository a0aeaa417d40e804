"""Token counts that follow edits.

A document is cut into pre-tokens by the tokenizer's pattern. Each pre-token's token
count is known by itself, so a document is a sequence of (characters, tokens).
The sequence is kept in leaves under a segment tree whose nodes hold the sums of
both. An edit finds its leaf by descending the character sums, cuts the text anew
only from the last pre-token whose match cannot have looked at the edit to the
first old boundary that the new cut meets again, encodes only those pre-tokens,
splices them into the leaves and updates the sums on the way up.

The pattern looks at most two characters beyond a pre-token (a contraction's
letters, or the character after white space), and never back; so pre-tokens that
end two characters before the edit stay, and from a common boundary
behind the edit everything stays.

Defined results: null text counts as empty (no tokens); edits apply in order of
`seq`, each to the text that the ones before left; places beyond the end mean the
end, negative ones the beginning; a null replacement deletes; edits of unknown
documents are ignored; documents without edits keep their counts. Edits of one
document travel in its row, at most as many as the caller gives it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

#: Pre-tokens of a new leaf; characters by which a pre-token's match may look ahead.
LEAF, AHEAD = 64, 2
KEPT, BATCH_BYTES = 300_000, 2 << 20


class Counter(dict):
    """Token counts of pre-tokens, kept in a bounded table."""

    def __init__(self, ranks: bytes, pattern: str):
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Document:
    """A text with its segment tree."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.pattern.findall(text)
        sizes, counts = [len(p) for p in pieces], [counter[p] for p in pieces]
        self.leaves = [(sizes[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(sizes), LEAF)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        """Build all sums over the leaves."""
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.width = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for k, (sizes, counts) in enumerate(self.leaves):
            self.chars[n + k], self.tokens[n + k] = sum(sizes), sum(counts)
        for k in range(n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character place (the last one at the end) and where it begins."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if place >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def _refresh(self, leaf: int) -> None:
        k = self.width + leaf
        self.chars[k], self.tokens[k] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        k //= 2
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end)."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # From the first pre-token whose match may have seen the edit.
        leaf, at = self._leaf_at(max(start - AHEAD, 0))
        while leaf and at > start - AHEAD:
            leaf -= 1
            at -= self.chars[self.width + leaf]
        first, skip = leaf, 0
        for size in self.leaves[leaf][0]:
            if at + size + AHEAD > start:
                break
            at += size
            skip += 1
        # Cut anew until a new boundary is an old one behind the edit.
        sizes, counts = [], []
        old_leaf, old_k, old = leaf, skip, at
        place = at
        for found in self.counter.pattern.finditer(self.text, at):
            place = found.end()
            sizes.append(place - found.start())
            counts.append(self.counter[found.group()])
            while old < place - shift or old < end:
                if old_k < len(self.leaves[old_leaf][0]):
                    old += self.leaves[old_leaf][0][old_k]
                    old_k += 1
                elif old_leaf + 1 < len(self.leaves):
                    old_leaf, old_k = old_leaf + 1, 0
                else:
                    break
            if old >= end and old + shift == place:
                break
        else:
            old_leaf, old_k = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(sizes)
        # Splice the new pre-tokens in: they go to the first leaf, others only lose what was cut anew.
        head, tail = self.leaves[first], self.leaves[old_leaf]
        rest = [part[old_k:] for part in tail]
        if old_leaf == first:
            self.leaves[first] = (head[0][:skip] + sizes + rest[0], head[1][:skip] + counts + rest[1])
        else:
            self.leaves[first] = (head[0][:skip] + sizes, head[1][:skip] + counts)
            for k in range(first + 1, old_leaf):
                self.leaves[k] = ([], [])
                self._refresh(k)
            self.leaves[old_leaf] = (rest[0], rest[1])
            self._refresh(old_leaf)
        if len(self.leaves[first][0]) > 8 * LEAF:
            flat = [(s, c) for part in self.leaves for s, c in zip(*part)]
            self.leaves = [([s for s, _ in flat[a : a + LEAF]], [c for _, c in flat[a : a + LEAF]]) for a in range(0, len(flat), LEAF)]
            self._grow()
        else:
            self._refresh(first)

    def pretokens(self) -> int:
        return sum(len(s) for s, _ in self.leaves)


_LOADED: dict[tuple[bytes, str], Counter] = {}


def loaded(ranks: bytes, pattern: str) -> Counter:
    """Counter of this worker process."""
    if (ranks, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[ranks, pattern] = Counter(ranks, pattern)
    return _LOADED[ranks, pattern]


def count_edited(df: DataFrame, ranks: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Apply each row's `edits`, an array of (start, stop, replacement), to its text, and count.

    Adds n_before, n_after, n_pretokens, n_reencoded and the edited text as `edited`; text and edits are dropped.
    `ranks` is the rank file's path on the driver.
    """
    with open(ranks, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, under 1 MB
    new = ("n_before", "n_after", "n_pretokens", "n_reencoded", "edited")
    keep = [f for f in df.schema.fields if f.name not in (text, edits, *new)]
    schema = T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in new[:4]), T.StructField("edited", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(data.value, pattern)
        for batch in by_bytes(batches, text, BATCH_BYTES):
            rows = []
            for t, changes in zip(batch.column(text).to_pylist(), batch.column(edits).to_pylist()):
                doc = Document(t or "", counter)
                before = doc.total
                for e in changes or ():
                    doc.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                rows.append((before, doc.total, doc.pretokens(), doc.encoded, doc.text))
            cols = list(zip(*rows))
            arrays = [*(pa.array(np.array(c, dtype=np.int64)) for c in cols[:4]), pa.array(cols[4], type=pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Join edits (doc_id, seq, start, stop, replacement) to their documents as an array column `edits`."""
    one = F.struct("seq", "start", "stop", "replacement")
    grouped = edits.groupBy(F.col(doc_id).alias("_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
    return docs.join(grouped, F.col(doc_id) == F.col("_id"), "left").drop("_id")
