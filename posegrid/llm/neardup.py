"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is summed up in `m` registers
K_i = floor(1 - log_b(min over the set of h_i)), h_i exponential with rate a:
exponentially spaced, truncated minima, which merge by maximum and agree between
two sets with a probability close to their Jaccard similarity.

1. sketch: set size, digest of the word sequence, registers.
2. Rows with one digest are one text, however many rows and ids it has; they become
   one vertex, named by that digest. So copies never meet pair by pair.
3. Candidates: all members of a band bucket are held against one center, the bucket's
   smallest digest. Each pair goes through the joint likelihood of the registers and
   then an exact count over the full sets. Verified links make components.
4. In buckets that still hold several components, the members outside the
   largest one meet all members of other components, in blocks of bounded size
   that yield only pairs which reach the threshold by their fingerprints: pairs that
   the registers alone let through can be as many as the square of a group. Where that
   would be too much work, the bucket is first split by every later band, which goes
   back to 3 and leaves fewer components. Then what is still mixed in the whole bucket
   meets in blocks too, whatever the work. So no bucket is capped, pairs are lost
   at no size, and none are compared within a component.

Before the wide exchanges (band keys, texts) a bitmap of bounded size drops most of
the rows that have no partner; exact joins follow.

A pair at the threshold shares no band with probability (1 - s^r)^bands: for the
defaults 3e-7 at 0.8 and 2e-9 at 0.85; the likelihood filter leaves six standard
errors of room.

Defined results: null or wordless text has an empty set (size 0), links with
nothing and is kept; a doc_id may stand for several texts: each text is a vertex of
its own, and component_id is the smallest doc_id that any text of the component
has; a null doc_id keeps its row and takes the smallest doc_id of its component,
or null if that has none; repeated rows share a component; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import Bitmap
from .common import Workspace, slices, text_bytes, tidy, unused
from .components import connected_components
from .shingles import digests, mix, multipliers, shingles, word_bytes, words

#: SetSketch parameters: base, rate and number of register steps.
BASE, RATE, STEPS = 1.02, 20.0, 65_534
ROWS, BANDS = 5, 36
M = ROWS * BANDS
#: Members of a block, and comparisons up to which a bucket is not split by a further band.
BLOCK, WORK = 1024, 1 << 23
#: So many times a bucket is split by a further band before what is still mixed in it is compared in blocks, whatever the work.
LEVELS = 3
#: Standard errors by which the likelihood estimate may fall short of the threshold.
ROOM = 6.0
BATCH_BYTES, SLICE = 1 << 20, 1 << 15
_WORD = word_bytes(False)
_A, _B = multipliers(M, 11), multipliers(M, 23)


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers, (n, M) uint16, of non-empty sets given as runs of shingle hashes."""
    least = np.full((len(bounds) - 1, M), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, int(bounds[-1]), SLICE):
        part = hashes[a : a + SLICE]
        first = int(np.searchsorted(bounds, a, side="right")) - 1
        last = int(np.searchsorted(bounds, a + len(part), side="left"))
        cuts = np.maximum(bounds[first:last] - a, 0)
        room = least[first:last]
        buffer = np.empty_like(part)
        for k in range(M):
            np.multiply(part, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            room[:, k] = np.minimum(room[:, k], np.minimum.reduceat(buffer, cuts))
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    waits = np.maximum(-np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE, 1e-300)
    return np.clip(np.floor(1.0 - np.log(waits) / np.log(BASE)), 0, STEPS + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its number and its registers."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, r])
    return keys.view(np.int64)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers of a above, below and equal to those of b."""
    above = (a > b).sum(axis=1).astype(np.float64)
    below = (a < b).sum(axis=1).astype(np.float64)
    return above, below, a.shape[1] - above - below


def _likelihood(counts: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Joint log-likelihood of a similarity j, for sets with shares u and v of the sizes' sum."""

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    above, below, same = counts
    up, down = p(u - v * j), p(v - u * j)
    return above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity from registers and set sizes."""
    counts, u, v = _counts(a, b), na / (na + nb), nb / (na + nb)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in the similarity
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = _likelihood(counts, u, v, x) < _likelihood(counts, u, v, y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, floor: float) -> np.ndarray:
    """Whether the estimate is at least `floor`: the likelihood still rises there, or sizes end it there."""
    u, v = na / (na + nb), nb / (na + nb)
    counts = _counts(a, b)
    return _likelihood(counts, u, v, floor + 1e-4) >= _likelihood(counts, u, v, floor - 1e-4)


def _vertices(d1: np.ndarray, d2: np.ndarray) -> list[bytes]:
    """Digests as 16 bytes each."""
    raw = np.column_stack([d1, d2]).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def sketch(df: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, hash of the text as it stands, n_shingles, vertex v (digest of its words), regs; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, BATCH_BYTES):
                part = data[offsets[a] : offsets[b]]
                hashes, starts = words(part, offsets[a : b + 1] - offsets[a], _WORD)
                runs, bounds = shingles(hashes, starts, width)
                sizes, sets = np.zeros(b - a, dtype=np.int64), []
                for i in range(b - a):
                    sets.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
                    sizes[i] = len(sets[-1])
                there = sizes > 0
                regs = np.zeros((b - a, M), dtype=np.uint16)
                if there.any():
                    full = sizes[there]
                    regs[there] = registers(np.concatenate(sets), np.concatenate([[0], np.cumsum(full)]))
                names = _vertices(*digests(hashes, starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        pa.array(sizes),
                        pa.array([v if t else None for t, v in zip(there, names)], type=pa.binary()),
                        pa.array([r.tobytes() if t else None for t, r in zip(there, regs)], type=pa.binary()),
                    ],
                    names=["doc_id", "key", "n_shingles", "v", "regs"],
                )

    return _keyed(df, doc_id, text).mapInArrow(tidy(run), "doc_id long, key long, n_shingles long, v binary, regs binary")


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def banded(reps: DataFrame) -> DataFrame:
    """Per (v, regs): v and its band keys, `bands`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, M)
                offsets = pa.array(np.arange(len(regs) + 1, dtype=np.int32) * BANDS)
                keys = pa.ListArray.from_arrays(offsets, pa.array(band_keys(regs).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("v"), keys], names=["v", "bands"])

    return reps.select("v", "regs").mapInArrow(tidy(run), "v binary, bands array<long>")


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose set sizes and registers allow a similarity of `least`."""
    side = lambda s: reps.select(F.col("v").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    floor = least - ROOM * np.sqrt(least * (1 - least) / M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                keep = reaches(ra, rb, na, nb, floor)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def fingerprints(reps: DataFrame, width: int) -> DataFrame:
    """Per (v, n_shingles, regs, text): v, n_shingles, regs and the sorted distinct shingle hashes cut to 32 bits, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, BATCH_BYTES):
                hashes, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _WORD)
                runs, bounds = shingles(hashes, starts, width)
                short = (runs >> np.uint64(32)).astype(np.uint32)
                packed = [np.unique(short[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                own = [batch.column(c).slice(a, b - a) for c in ("v", "n_shingles", "regs")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(packed, type=pa.binary())], names=["v", "n_shingles", "regs", "prints"])

    return reps.select("v", "n_shingles", "regs", "text").mapInArrow(tidy(run), "v binary, n_shingles long, regs binary, prints binary")


def across(members: DataFrame, reps: DataFrame, least: float, width: int, once: bool) -> DataFrame:
    """Likely pairs (a, b) across components in buckets (bucket, band, v, label, size, top, rest).

    `rest` members lie outside the largest component `top`. They are dealt to blocks,
    as all members are, and each pair of blocks is one group of bounded size. With
    `once`, a pair that meets in several bands is looked at in the first. Register likelihood comes
    first, then a count over 32-bit fingerprints, which can only overstate the
    similarity; what is left is for the exact check.
    """
    floor = least - ROOM * np.sqrt(least * (1 - least) / M)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("v"), blocks(n)).cast("int")
    printed = fingerprints(reps.join(members.select("v").distinct(), "v", "left_semi"), width)
    named = members.join(printed, "v")
    own = ["bucket", "band", "v", "label", "n_shingles", "regs", "prints"]
    every = named.select(*own, F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0), blocks("rest") - 1)).alias("x"), spot("size").alias("y"))
    few = named.where("label <> top").select(*own, F.lit(True).alias("few"), spot("rest").alias("x"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("y"))

    def run(table: pa.Table) -> pa.Table:
        few = table.column("few").to_numpy()
        names, codes = table.column("v").to_pylist(), {}
        labels = np.array([codes.setdefault(x, len(codes)) for x in table.column("label").to_pylist()])
        sizes = table.column("n_shingles").to_numpy().astype(np.float64)
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, M)
        prints = [np.frombuffer(x, dtype=np.uint32) for x in table.column("prints").to_pylist()]
        band = int(table.column("band")[0].as_py()) if once and len(few) else 0
        every = np.flatnonzero(~few)
        out: list[tuple[bytes, bytes]] = []
        for k in np.flatnonzero(few):
            n = sizes[k]
            at = every[(labels[every] != labels[k]) & (np.minimum(sizes[every], n) >= least * np.maximum(sizes[every], n))]
            if not len(at):
                continue
            same = regs[at] == regs[k]
            near = same.mean(axis=1) >= floor - 0.1  # equal registers can't overstate the similarity by so much
            at, same = at[near], same[near]
            before = same[:, : band * ROWS].reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
            at = at[~before]
            if len(at):
                at = at[reaches(np.broadcast_to(regs[k], (len(at), M)), regs[at], np.full(len(at), n), sizes[at], floor)]
            if len(at):
                own, others = prints[k], [prints[j] for j in at]
                counts = np.array([len(x) for x in others])
                flat = np.concatenate(others)
                found = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                hits = np.concatenate([[0], np.cumsum(own[found] == flat)])
                ends = np.cumsum(counts)
                common = hits[ends] - hits[ends - counts]
                at = at[common >= least * (len(own) + counts - common) - 2]
                out += [(max(names[j], names[k]), min(names[j], names[k])) for j in at]
        return pa.table({"a": pa.array([x for x, _ in out], type=pa.binary()), "b": pa.array([y for _, y in out], type=pa.binary())})

    return every.unionByName(few).groupBy("bucket", "x", "y").applyInArrow(run, "a binary, b binary").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union over the full shingle sets."""
    side = lambda s: texts.select(F.col("v").alias(s), F.col("text").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(col: pa.Array) -> Iterator[np.ndarray]:
            data, offsets = text_bytes(col)
            hashes, starts = words(data, offsets, _WORD)
            runs, bounds = shingles(hashes, starts, width)
            return [np.unique(runs[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]

        for batch in batches:
            _, offsets = text_bytes(batch.column("ta"))
            for a, b in slices(offsets, BATCH_BYTES):
                part = batch.slice(a, b - a)
                keep = []
                for x, y in zip(sets(part.column("ta")), sets(part.column("tb"))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def texts_of(df: DataFrame, reps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per vertex (v, least, key, n_shingles, regs) of `reps` v, n_shingles, regs and its text, found by doc_id and text hash."""
    rows = Bitmap(reps, "least", "key").split(_keyed(df, doc_id, text), "doc_id", "key", held=True)
    rows = rows.groupBy("doc_id", "key").agg(F.max("text").alias("text")).withColumnRenamed("key", "_key")
    return reps.join(rows, F.col("least").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("_key"))).select("v", "n_shingles", "regs", "text")


def grouped(df: DataFrame, width: int, percent: int, doc_id: str, text: str, work: Workspace) -> DataFrame:
    """Per row of df: doc_id, text hash `key`, n_shingles, root (one name for each component, null for an empty set), component_id."""
    rows = work.save(sketch(df, width, doc_id, text), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))  # null ids last
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(first.alias("f"), F.max(F.struct("n_shingles", "regs")).alias("s"))
    reps = work.save(classes.select("v", F.col("f.doc_id").alias("least"), "f.key", "s.n_shingles", "s.regs"), "classes")
    rows = work.save(rows.select("doc_id", "key", "n_shingles", "v"), "rows", rows)

    shared = work.save(banded(reps).select(F.explode("bands").alias("bucket")).groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    buckets = banded(reps).select("v", F.posexplode("bands").alias("band", "bucket"))
    buckets = work.save(Bitmap(shared, "bucket").split(buckets, "bucket", held=True), "maybe", shared)
    met = work.save(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("v").alias("center")).where("size > 1"), "bucket"), "buckets", buckets)
    paired = work.save(met.select("v").distinct(), "paired")
    wanted = work.save(Bitmap(paired, "v").split(reps, "v", held=True).join(paired, "v", "left_semi"), "wanted", paired)
    vertices = work.save(reps.select("v", "least"), "vertices", reps)
    seen = work.save(texts_of(df, wanted, doc_id, text), "texts", wanted)

    def links_of(pairs: DataFrame) -> DataFrame:
        return work.save(verified(pairs, seen, width, percent), "verified")

    stars = met.where("v <> center").select(F.col("v").alias("a"), F.col("center").alias("b")).distinct()
    links = links_of(likely(stars, seen, percent / 100))
    labels = work.save(connected_components(links, work), "labels")
    level, hot, whole = 0, met.where("size > 2").select("bucket", "band", "v"), None
    while True:
        named = hot.join(labels, "v", "left").select("bucket", "band", "v", F.coalesce("component", "v").alias("label"))
        sizes = named.groupBy("bucket", "label").count().groupBy("bucket")
        mixed = sizes.agg(F.sum("count").alias("size"), F.max_by("label", F.struct("count", "label")).alias("top"), (F.sum("count") - F.max("count")).alias("rest")).where("rest > 0")
        open_ = work.save(named.join(mixed, "bucket"), "open")
        near = F.col("size") * F.col("rest") <= WORK if level <= LEVELS else F.lit(True)
        counts = open_.agg(F.count_if(near), F.count_if(~near)).first()
        if not level and counts[1]:
            whole = open_.where(~near).select("bucket", "band", "v")
        split = counts[1] and level < LEVELS
        if counts[0] or split:
            pairs = across(open_.where(near), seen, percent / 100, width, level in (0, LEVELS + 1))
            if split:
                large = open_.where(~near).select("bucket", "band", "v")
                keyed = large.join(banded(seen), "v").select("v", "bucket", "band", F.posexplode("bands")).where("pos > band")
                keyed = keyed.select("v", F.col("pos").alias("band"), F.xxhash64("bucket", "col").alias("bucket"))
                finer = work.save(keyed.join(keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("v").alias("center")).where("size > 1"), "bucket"), "finer")
                stars = finer.where("v <> center").select(F.col("v").alias("a"), F.col("center").alias("b")).distinct()
                pairs = pairs.unionByName(likely(stars, seen, percent / 100)).distinct()
            found = links_of(work.save(pairs, "pairs"))
            links = work.save(links.unionByName(found), "links")
            labels = work.save(connected_components(links, work), "labels")
        if split:
            level, hot = level + 1, finer.where("size > 2").select("bucket", "band", "v")
        elif whole is not None:
            level, hot, whole = LEVELS + 1, whole, None
        else:
            break
    least = labels.join(vertices, "v").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = labels.join(least, "component").select("v", "component", "component_id")
    named = vertices.join(linked, "v", "left").select("v", F.coalesce("component", "v").alias("root"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    result = rows.join(named, "v", "left")
    lone = F.col("root").isNull()
    return work.save(result.select("doc_id", "key", "n_shingles", "root", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "result")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable.
    """
    work = Workspace(df.sparkSession)
    result = grouped(df, width, percent, doc_id, text, work)
    work.drop(result)
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, one document of each group of near duplicates, and repeated rows once.

    The row with the smallest doc_id stays; where that id stands for several texts
    of the group, the one with the least text hash. Rows that differ in other
    columns only count as repeated. Documents without words all stay, but for repeated rows.
    """
    work = Workspace(df.sparkSession)
    rows = grouped(df, width, percent, doc_id, text, work)
    lead = F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = rows.where(~lead).select("doc_id", "key")
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        leads = rows.where(lead & F.col("root").isNotNull())
        best = leads.groupBy("root").agg(F.min("key").alias("best"))
        gone = gone.unionByName(leads.join(best, "root").where("key > best").select("doc_id", "key"))
    own_id, own_key = unused("own_id", df), unused("own_key", df)
    keyed = df.withColumns({own_id: F.col(doc_id).cast("long"), own_key: F.xxhash64(text)})
    gone_id, gone_key = unused("gone_id", df), unused("gone_key", df)
    gone = work.save(gone.toDF(gone_id, gone_key).distinct(), "gone", rows)
    marks = Bitmap(gone, gone_id, gone_key)
    maybe = marks.split(keyed, own_id, own_key, held=True)
    maybe = maybe.join(gone, F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_key) == F.col(gone_key)), "left_anti")
    kept = marks.split(keyed, own_id, own_key, held=False).unionByName(maybe)
    work.drop(gone)
    return (kept.dropDuplicates([own_id, own_key]) if repeated else kept).drop(own_id, own_key)
