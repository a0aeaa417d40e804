"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three code points of the lower-cased
text, digits and punctuation as blanks) weighted by TF-IDF, with unit length. The
weights are trained with follow-the-regularised-leader (FTRL-proximal, elastic
net), which leaves most of them at zero; a temperature fitted on rows held back
from training calibrates the scores.

Document frequencies cover every training row. The classifier is fitted on a
bounded sample of them: about `per_label` rows of each label, picked by a hash of
the id, whose sparse features alone reach the driver: packed bytes, 8 for each
distinct n-gram of a row, unpacked one row at a time. Where a dirty column holds
more than `most_labels` labels, the most frequent ones are learned.

Defined results: null text, and text without a letter, gets `und` and score 0; rows
whose lang or doc_id is null never train, and a null doc_id counts as not held out;
without any training row every text is `und`; ties go to the label that sorts
first; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, tidy


#: Hashed features, n-gram orders and rows a label may give the fit.
BITS, ORDERS, PER_LABEL = 16, (1, 2, 3), 1500
#: Labels that are learned at most, the most frequent ones; no real set of languages reaches it.
MOST_LABELS = 512
SIZE = 1 << BITS
#: FTRL-proximal: learning rate, its offset, elastic-net penalties; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.01, 3
UND = "und"
#: Form of packed features; their bytes sort as their numbers do.
PACKED = ">i4"
#: Odd multipliers of the n-gram hash.
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _symbols() -> np.ndarray:
    """For each code point of the basic plane: lower-cased letter's code, else 32."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and their counts; none if it has no letter."""
    if not _TABLE:
        _TABLE.append(_symbols())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.full(len(codes) + 2, 32, dtype=np.uint32)
    if len(codes) and codes.max() > 65535:
        letters = np.array([chr(c).isalpha() for c in codes[codes > 65535].tolist()])
        low[1:-1] = _TABLE[0][np.minimum(codes, 65535)]
        low[1:-1][codes > 65535] = np.where(letters, codes[codes > 65535], 32)
    else:
        low[1:-1] = _TABLE[0][codes]
    solid = low != 32
    solid[1:] |= solid[:-1]
    solid[0] = True
    low = low[solid]  # runs of blanks become one
    if len(low) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    value, parts = np.zeros(len(low), dtype=np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(low) - n + 1] * _STEP + low[n - 1 :]
        if n in ORDERS:
            parts.append((value + np.uint32(n)) * _SPREAD >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(parts), minlength=SIZE)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


@dataclass
class Model:
    """Labels, inverse document frequencies, weights (features, labels), bias and temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels:
            return UND, 0.0
        at, counts = ngrams(text)
        if not len(at):
            return UND, 0.0
        z = self.logits(at, counts) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.labels[best], float(p[best] / p.sum())


def unpacked(at: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One row's features and counts, as ngrams() gives them."""
    return np.frombuffer(at, dtype=PACKED).astype(np.int64), np.frombuffer(counts, dtype=PACKED).astype(np.float64)


def fit(labels: list[str], rows: list[tuple[bytes, bytes, int]], idf: np.ndarray) -> Model:
    """FTRL-proximal over the sample of packed features, counts and labels' places; each fifth row is kept for the temperature."""
    k = len(labels)
    model = Model(labels, idf, np.zeros((SIZE, k)), np.zeros(k))
    train = [r for i, r in enumerate(rows) if i % 5] or rows
    kept = [r for i, r in enumerate(rows) if not i % 5] or rows
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for step in range(PASSES):
        for i in np.random.default_rng(step).permutation(len(train)):
            at, counts = unpacked(*train[i][:2])
            at, x, y = np.append(at, SIZE), np.append(model.vector(at, counts), 1.0), train[i][2]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            squares = n[at]
            z[at] += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / ALPHA * w
            n[at] = squares + g * g
    every = weights(np.arange(SIZE + 1))
    model.weights, model.bias = every[:SIZE], every[SIZE]
    if kept:
        s = np.array([model.logits(*unpacked(at, c)) for at, c, _ in kept])
        y = np.array([r[2] for r in kept])
        smooth = 1.0 / (len(y) + 2)  # else a faultless fit would have no best temperature

        def loss(t: float) -> float:
            u = s / t
            top = u.max(axis=1, keepdims=True)
            logp = u - top - np.log(np.exp(u - top).sum(axis=1, keepdims=True))
            right = logp[np.arange(len(y)), y].mean()
            return -float((1 - smooth) * right + smooth * logp.mean())

        low, high = np.log(0.05), np.log(20.0)
        for _ in range(60):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def _features(df: DataFrame) -> DataFrame:
    """Sparse features of the rows (label, text): label, at, counts; the last two packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [ngrams(t or "") for t in part.column("text").to_pylist()]
                packed = [pa.array([x[k].astype(PACKED).tobytes() for x in found], type=pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("label"), *packed], names=["label", "at", "counts"])

    return df.mapInArrow(tidy(run), "label string, at binary, counts binary")


def _frequencies(df: DataFrame) -> DataFrame:
    """Document frequency of every feature over all rows of (text); each task sends one count per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                at, _ = ngrams(t or "")
                total[at] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["at", "df"])

    return df.mapInArrow(tidy(run), "at int, df long").groupBy("at").agg(F.sum("df").alias("df"))


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL, most_labels: int = MOST_LABELS) -> Model:
    """Fit on the rows with a non-null text, label and id. `per_label` bounds the sample of each label, `most_labels` their number."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()}
    if not sizes:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0))
    labels = sorted(sizes)
    rows = rows.where(F.col("label").isin(labels))
    df_counts = np.zeros(SIZE)
    for r in _frequencies(rows.select("text")).toLocalIterator():  # at most SIZE rows
        df_counts[r["at"]] = r["df"]
    total = sum(sizes.values())
    idf = np.log((1.0 + total) / (1.0 + df_counts)) + 1.0
    spot = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double") / 1_000_000
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, per_label / sizes[k])))])
    sample = _features(rows.where(spot < share[F.col("label")]).select("text", "label"))
    place = {k: i for i, k in enumerate(labels)}
    found = sorted((bytes(r["at"]), bytes(r["counts"]), place[r["label"]]) for r in sample.toLocalIterator() if r["at"])
    order = np.random.default_rng(7).permutation(len(found))  # equal on every run, whatever order the rows came in
    model = fit(labels, [found[i] for i in order], idf)
    del found
    give_back()
    return model


def identify(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the columns `lang` and `score`; columns of those names are replaced."""
    keep = [f for f in df.schema.fields if f.name not in (lang, score)]
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed by SIZE and the number of languages
    schema = df.select([f.name for f in keep]).schema.add(lang, "string").add(score, "double")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                said = [net.predict(t) for t in part.column(at).to_pylist()]
                cols = [*(part.column(f.name) for f in keep), pa.array([s for s, _ in said], type=pa.string()), pa.array([p for _, p in said], type=pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no training may see: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
