"""Balanced shards by histogram sort, in DataFrame operations only.

The rows' sort key is 128 bits wide: a 64-bit hash of the text, then doc_id, so
equal texts lie side by side and a group is cut only where balance asks for it.
Splitters are found without moving rows: each pass counts the exact bytes of all
keys by the next digits of the keys around each open splitter, until a
candidate boundary lies within the tolerance of its target, or one row or key is
left. Only such counts, at most 64 for each open splitter and pass, reach the driver.
Then rows learn their range by a lookup and are exchanged once.

By law `bytes` a shard's boundary lies within TOLERANCE of its target, or at the
nearer edge of the one row that spans the target; so a shard's size can differ from
the mean by TOLERANCE or by the size of its largest row, whichever is more.

Each shard consists of several ranges, so that no task sorts a whole shard; a
row's slot is its place in its range plus the rows of the shard's earlier ranges.

Defined results: null text has no bytes (size 1) and the checksum of no bytes, 0; a
null doc_id sorts first among equal texts; an empty table gives no rows; other
columns are ignored. doc_id identifies a row: rows that repeat a doc_id together
with its text stay in one range.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Bits by which a pass refines the text hash and then doc_id.
HASH_DIGITS, ID_DIGITS = (6,) * 10 + (4,), (6,) * 10 + (4,)
LEVELS = len(HASH_DIGITS) + len(ID_DIGITS)
#: Leading bits of the text hash by which rows look up their range.
LOOKUP_BITS = 12
#: Error allowed to a shard's boundary, in shares of a shard, and to a range's boundary inside it, in shares of a range.
TOLERANCE, LOOSE = 0.0005, 0.1
#: Rows a range should have; ranges per shard at least and at most.
RANGE_ROWS, FEWEST, MOST = 100_000, 4, 256
_MIN = -(1 << 63)


@dataclass
class _Splitter:
    """A boundary being refined: it lies within the keys that begin with `prefix`."""

    target: float
    tolerance: float
    prefix: tuple[int, ...] = ()
    below: int = 0
    found: tuple[int, int] | None = None


def _key(prefix: list[int]) -> tuple[int, int]:
    """The least key (hash, doc_id) that begins with the digits, as signed 64-bit values."""
    values = []
    for digits in (HASH_DIGITS, ID_DIGITS):
        value = 0
        for k, bits in enumerate(digits):
            value = value << bits | (prefix[k] if k < len(prefix) else 0)
        prefix = prefix[len(digits) :]
        values.append(value + _MIN)
    return values[0], values[1]


def _digit(level: int) -> Column:
    digits, column = (HASH_DIGITS, "h") if level < len(HASH_DIGITS) else (ID_DIGITS, "i")
    level -= 0 if column == "h" else len(HASH_DIGITS)
    left = 64 - sum(digits[: level + 1])
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(_MIN)), left).bitwiseAND(F.lit((1 << digits[level]) - 1))


def splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """For each (target, tolerance), ascending, a key (h, i) with about so much weight `w` below it."""
    open_ = [_Splitter(t, tol) for t, tol in targets]
    for level in range(LEVELS):
        now = [s for s in open_ if s.found is None and len(s.prefix) == level]
        if not now:
            continue
        wanted = sorted({s.prefix for s in now})
        part = keys
        names = [f"p{k}" for k in range(level)]
        if level:
            part = part.withColumns({n: _digit(k) for k, n in enumerate(names)})
            local = keys.sparkSession.createDataFrame(wanted, ", ".join(f"{n} long" for n in names))
            part = part.join(F.broadcast(local), names, "left_semi")  # one row per open splitter
        counted = part.groupBy(*names, _digit(level).alias("d")).agg(F.sum("w").alias("w"), F.count("*").alias("n"), *(f(c).alias(n) for n, f, c in (("h0", F.min, "h"), ("h1", F.max, "h"), ("i0", F.min, "i"), ("i1", F.max, "i")))).collect()
        inside: dict[tuple, list] = defaultdict(list)
        for r in counted:
            inside[tuple(r[n] for n in names)].append((r["d"], r["w"], r["n"], _common(r["h0"], r["h1"], r["i0"], r["i1"])))
        for buckets in inside.values():
            buckets.sort(key=lambda b: b[0])
        for s in now:
            below = s.below
            for d, w, n, prefix in inside[s.prefix]:
                if below + w >= s.target:
                    near, far = s.target - below, below + w - s.target
                    if near <= s.tolerance or far <= s.tolerance or n == 1 or len(prefix) == LEVELS:
                        s.found = _key([*s.prefix, d]) if near <= far else _after([*s.prefix, d])
                    else:
                        s.prefix, s.below = prefix, below  # digits that all these keys share need no pass
                    break
                below += w
            else:
                s.found = (1 << 63) - 1, (1 << 63) - 1
    return [s.found for s in open_]


def _common(h0: int, h1: int, i0: int, i1: int) -> tuple[int, ...]:
    """Leading digits shared by all keys whose hashes and ids lie in these ranges."""
    out: list[int] = []
    for low, high, digits in ((h0, h1, HASH_DIGITS), (i0, i1, ID_DIGITS)):
        left = 64
        for bits in digits:
            left -= bits
            if (low - _MIN) >> left != (high - _MIN) >> left:
                return tuple(out)
            out.append((low - _MIN) >> left & ((1 << bits) - 1))
    return tuple(out)


def _after(prefix: list[int]) -> tuple[int, int]:
    """The least key beyond all that begin with the digits."""
    digits = (HASH_DIGITS + ID_DIGITS)[: len(prefix)]
    value = 0
    for d, bits in zip(prefix, digits):
        value = value << bits | d
    value = (value + 1) << (128 - sum(digits))
    if value >> 128:
        return (1 << 63) - 1, (1 << 63) - 1
    return (value >> 64) + _MIN, (value & ((1 << 64) - 1)) + _MIN


def shard(df: DataFrame, shards: int = 16, law: str = "bytes", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot. law `bytes` evens out the sizes, `rows` the counts."""
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    spark = df.sparkSession
    work = Workspace(spark)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = F.octet_length(raw).cast("long") + 1
    keys = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(raw).alias("text_crc32"),
        (size if law == "bytes" else F.lit(1).cast("long")).alias("w"),
        F.xxhash64(raw).alias("h"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_MIN)).alias("i"),
    )
    keys = work.save(keys, "keys")
    total = keys.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
    per = min(max(-(-total["n"] // (shards * RANGE_ROWS)), FEWEST), MOST)
    parts = shards * per
    exact = 0.5 if law == "rows" else TOLERANCE * total["w"] / shards
    targets = [(total["w"] * k / parts, exact if k % per == 0 else LOOSE * total["w"] / parts) for k in range(1, parts)]
    cuts = sorted(splitters(keys, targets)) if total["n"] else []
    # Lookup by the first bits of the hash: splitters before it, and those inside it; 4,096 rows at most.
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for h, i in cuts:
        inside[(h - _MIN) >> (64 - LOOKUP_BITS)].append((h, i))
    rows, before = [], 0
    for d in range(1 << LOOKUP_BITS):
        rows.append((d, before, inside.get(d, [])))
        before += len(inside.get(d, []))
    lookup = F.broadcast(spark.createDataFrame(rows, "d long, before int, cuts array<struct<h: long, i: long>>"))
    passed = F.filter("cuts", lambda s: (s["h"] < F.col("h")) | ((s["h"] == F.col("h")) & (s["i"] <= F.col("i"))))
    ranged = keys.withColumn("d", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(_MIN)), 64 - LOOKUP_BITS)).join(lookup, "d").withColumn("range", F.col("before") + F.size(passed))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # one row a range
    starts, at = [], 0
    for r in range(parts):
        at = 0 if r % per == 0 else at
        starts.append((r, r // per, at))
        at += counts.get(r, 0)
    offsets = F.broadcast(spark.createDataFrame(starts, "range int, shard int, start long"))
    ranked = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("h", "i")) - 1)
    return ranked.join(offsets, "range").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
