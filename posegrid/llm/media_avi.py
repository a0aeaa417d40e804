"""Media columns: AVI files of lossless motion JPEG, their frames and timed clips.

Every frame is a still of its own: 24 x 24 grey samples of 8 bits as a lossless
JPEG (process SOF3, left predictor, one Huffman table), because the usual lossy
process does not give all bytes back. The file is RIFF: a header list, a `movi`
list of `00dc` chunks, and an `idx1` index, by which the frames are found again.

All frames of a batch are coded and decoded in lockstep, one sample of each per
step. Clips: histograms of consecutive frames are compared; a frame whose
difference stands out from its neighbours' mean by a multiple of their spread, and
exceeds a floor, begins a new shot.

Defined results: null or empty text has no bytes and becomes one frame of filling
bytes; equal texts give equal files; a file of any length is stored and read whole;
a null file has a null payload and no clips; so has a damaged one, and one of
another format, and `error` says what is wrong with it; other rows are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, text_bytes

SIDE = 24
SAMPLES = SIDE * SIDE
RATE = 25
#: Frames coded or decoded together.
CHUNK = 4096
BATCH_BYTES = 4 << 20
#: Shot detection: histogram bins, neighbours on each side, spreads above the mean, least difference.
BINS, REACH, SPREADS, FLOOR = 16, 6, 3.0, 0.08
#: Code lengths of the difference categories 0 to 8 (no code may be all ones), shortest for what text makes most.
LENGTHS = {3: 2, 4: 2, 5: 3, 2: 3, 0: 4, 1: 4, 6: 4, 7: 5, 8: 6}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical prefix codes (code, length) by category, in the order of a DHT segment."""
    out, code, size = {}, 0, 0
    for category, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - size
        size = n
        out[category] = code, n
        code += 1
    return out


def _dht(lengths: dict[int, int]) -> bytes:
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    values = [c for c, _ in sorted(lengths.items(), key=lambda x: x[1])]
    return bytes([0, *counts, *values])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, _dht(LENGTHS)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
TAIL = b"\xff\xd9"


def _coder() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255 its bits and their number."""
    bits, sizes = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.int64)
    for category, (code, n) in _codes(LENGTHS).items():
        for d in range(-255, 256):
            if abs(d).bit_length() == category:
                extra = d if d >= 0 else d + (1 << category) - 1
                bits[d + 255], sizes[d + 255] = code << category | extra, n + category
    return bits, sizes


_BITS, _SIZES = _coder()


def _decoder(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 next bits the difference that they begin with and its number of bits (0: none)."""
    counts, values = dht[1:17], dht[17:]
    differences, sizes = np.zeros(1 << 16, dtype=np.int16), np.zeros(1 << 16, dtype=np.int64)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            category = values[k]
            total = n + category
            if total > 16:
                raise ValueError("difference codes of more than 16 bits are not supported")
            extra = np.arange(1 << category)
            value = np.where(extra >> max(category - 1, 0) & 1, extra, extra - (1 << category) + 1) if category else extra
            begin = code << (16 - n)
            differences[begin : begin + (1 << (16 - n))] = np.repeat(value, 1 << (16 - total))
            sizes[begin : begin + (1 << (16 - n))] = total
            code, k = code + 1, k + 1
        code <<= 1
    return differences, sizes


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of (n, SIDE, SIDE) uint8 frames: all bytes and n + 1 offsets."""
    n = len(samples)
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    at = d.reshape(n, SAMPLES) + 255
    sizes = _SIZES[at]
    ends = np.cumsum(sizes, axis=1)
    length = (ends[:, -1] + 7) // 8
    begin = np.concatenate([[0], np.cumsum(length)])
    pos = (begin[:-1, None] * 8 + ends - sizes).reshape(-1)
    shift = 24 - (pos & 7) - sizes.reshape(-1)
    value = _BITS[at].reshape(-1).astype(np.int64) << shift
    byte = pos >> 3
    total = int(begin[-1]) + 3
    out = np.zeros(total, dtype=np.int64)
    for lane in range(3):
        out += np.bincount(byte + lane, weights=(value >> (16 - 8 * lane)) & 255, minlength=total).astype(np.int64)
    out = out[:-3].astype(np.uint8)
    rest = length * 8 - ends[:, -1]
    out[begin[1:] - 1] |= ((1 << rest) - 1).astype(np.uint8)
    full = out == 0xFF
    stuffed = np.repeat(out, 1 + full)
    moved = np.concatenate([[0], np.cumsum(full)])
    stuffed[np.flatnonzero(full) + moved[:-1][full] + 1] = 0
    return stuffed, begin + moved[begin]


def decode_frames(data: np.ndarray, offsets: np.ndarray, dht: bytes) -> np.ndarray:
    """The (n, SIDE, SIDE) frames of entropy-coded data."""
    n = len(offsets) - 1
    stuffing = np.zeros(len(data), dtype=bool)
    stuffing[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    moved = np.concatenate([[0], np.cumsum(stuffing)])
    plain = np.concatenate([data[~stuffing], np.full(4, 255, dtype=np.uint8)]).astype(np.uint32)
    window = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    pos = (offsets - moved[offsets])[:-1].astype(np.int64) * 8
    limit = (offsets - moved[offsets])[1:].astype(np.int64) * 8
    differences, sizes = _decoder(dht)
    d = np.empty((SAMPLES, n), dtype=np.int16)
    bad = np.zeros(n, dtype=bool)
    for k in range(SAMPLES):
        w = window[np.minimum(pos >> 3, len(window) - 1)] >> (8 - (pos & 7)).astype(np.uint32) & 0xFFFF
        d[k] = differences[w]
        size = sizes[w]
        bad |= size == 0
        pos += size
    if bad.any() or (pos > limit).any():
        raise ValueError("damaged frame data")
    d = d.T.reshape(n, SIDE, SIDE).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of whole JPEG frames."""
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(c := _chunk(b"00dc", f))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frame rate, and place and size of every frame in the file, from its RIFF index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    pos, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    movi, rate, places = 0, 0.0, []
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, pos)
        body = pos + 8
        if name == b"LIST" and data[body : body + 4] == b"movi":
            movi = body
        elif name == b"LIST" and data[body : body + 4] == b"hdrl":
            rate = 1e6 / struct.unpack_from("<I", data, body + 12)[0]
        elif name == b"idx1":
            for kind, _, at, n in struct.iter_unpack("<4sIII", data[body : body + size]):
                if kind[2:] == b"dc":
                    place = movi + at
                    if data[place : place + 4] != kind or struct.unpack_from("<I", data, place + 4)[0] != n:
                        raise ValueError("the index does not fit the chunks")
                    places.append((place + 8, n))
        pos = body + size + (size & 1)
    if not places:
        raise ValueError("no index or no frame")
    return rate, places


def store(payload: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """One AVI file for each run of whole frames; bounds count frames."""
    frames = payload.reshape(-1, SIDE, SIDE)
    stills: list[bytes] = []
    for a in range(0, len(frames), CHUNK):
        data, offsets = encode_frames(frames[a : a + CHUNK])
        raw, places = data.tobytes(), offsets.tolist()
        stills += [b"".join((HEAD, raw[x:y], TAIL)) for x, y in zip(places, places[1:])]
    return [write_avi(stills[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def load(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Frames of all files, each file's first frame (n + 1 values), and frame rates."""
    bounds, rates, scans, tables = [0], [], [], set()
    heads: dict[bytes, bytes] = {}
    for data in files:
        rate, places = read_avi(data)
        rates.append(rate)
        for at, n in places:
            begin = data.index(b"\xff\xda", at, at + n)
            begin += 2 + struct.unpack_from(">H", data, begin + 2)[0]
            head = data[at:begin]
            if head not in heads:
                heads[head] = _table(head)
            tables.add(heads[head])
            scans.append(data[begin : at + n - 2])
        bounds.append(bounds[-1] + len(places))
    if len(tables) > 1:
        raise ValueError("all frames must share one code table")
    out = []
    for a in range(0, len(scans), CHUNK):
        part = scans[a : a + CHUNK]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in part])])
        out.append(decode_frames(np.frombuffer(b"".join(part), dtype=np.uint8), offsets, next(iter(tables))))
    return np.concatenate(out) if out else np.zeros((0, SIDE, SIDE), np.uint8), np.array(bounds), rates


def _table(head: bytes) -> bytes:
    """The code table of a JPEG head, which must announce a lossless SIDE x SIDE grey frame."""
    pos, dht, size = 2, b"", None
    while pos < len(head):
        marker, n = struct.unpack_from(">xBH", head, pos)
        body = head[pos + 4 : pos + 2 + n]
        if marker == 0xC3:
            size = struct.unpack_from(">BHHB", body)
        elif marker == 0xC4:
            dht = body
        elif marker == 0xDA and body[-3] != 1:
            raise ValueError("only the left predictor is supported")
        pos += 2 + n
    if size != (8, SIDE, SIDE, 1) or not dht:
        raise ValueError("only lossless grey frames of 24 x 24 are supported")
    return dht


def shots(frames: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each frame whether it begins a shot."""
    n = len(frames)
    if n == 0:
        return np.zeros(0, dtype=bool)
    at = np.repeat(np.arange(n, dtype=np.int64) * BINS, SAMPLES) + (frames.reshape(-1) >> 4)
    hist = np.bincount(at, minlength=n * BINS).reshape(n, BINS)
    d = np.zeros(n)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * SAMPLES)
    first = np.zeros(n, dtype=bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    d[first] = 0
    sizes = np.diff(bounds)
    t = np.arange(n)
    low = np.maximum(np.repeat(bounds[:-1] + 1, sizes), t - REACH)
    high = np.minimum(np.repeat(bounds[1:], sizes), t + REACH + 1)
    whole = np.round(d * 2 * SAMPLES).astype(np.int64)  # exact sums, the same in every batch
    s1 = np.concatenate([[0], np.cumsum(whole)])
    s2 = np.concatenate([[0], np.cumsum(whole * whole)])
    others = np.maximum(high - low - 1, 0)
    sum1, sum2 = s1[high] - s1[np.minimum(low, high)] - whole, s2[high] - s2[np.minimum(low, high)] - whole * whole
    some = np.maximum(others, 1)
    mean = sum1 / some
    spread = np.sqrt(np.maximum(sum2 / some - mean * mean, 0))
    cut = (others > 0) & (whole > mean + SPREADS * spread) & (d > FLOOR)
    return first | (cut & ~first)


def encode_avi(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replace a text column by its AVI file; `n_bytes` is added, other columns pass through."""
    keep = [f for f in df.schema.fields if f.name not in (text, media, "n_bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for a, b in slices(offsets, BATCH_BYTES):
                sizes = np.diff(offsets[a : b + 1])
                frames = np.maximum((sizes + SAMPLES - 1) // SAMPLES, 1)
                bounds = np.concatenate([[0], np.cumsum(frames)])
                payload = np.full(bounds[-1] * SAMPLES, 255, dtype=np.uint8)
                shift = np.repeat(bounds[:-1] * SAMPLES - (offsets[a:b] - offsets[a]), sizes)
                payload[np.arange(offsets[b] - offsets[a]) + shift] = data[offsets[a] : offsets[b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in keep), pa.array(sizes), pa.array(store(payload, bounds), type=pa.binary())],
                    names=[*(f.name for f in keep), "n_bytes", media],
                )

    return df.mapInArrow(run, T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())]))


def _files(batches: Iterator[pa.RecordBatch], media: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(media)
        sizes = np.concatenate([[0], np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in col])])
        for a, b in slices(sizes, BATCH_BYTES):
            part = batch.slice(a, b - a)
            yield part, part.column(media).to_pylist()


def _loaded(files: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[float], list[str | None]]:
    """As `load`, with what is wrong with each file; null and damaged files have no frames."""
    present = [f for f in files if f is not None]
    try:
        if len(present) == len(files):
            return *load(files), [None] * len(files)
        raise ValueError("null file")
    except (ValueError, IndexError, KeyError, struct.error):  # one by one, to tell which
        frames, bounds, rates, errors = [], [0], [], []
        for data in files:
            error, one, rate = None, np.zeros((0, SIDE, SIDE), np.uint8), [0.0]
            if data is not None:
                try:
                    one, _, rate = load([data])
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
            frames.append(one)
            bounds.append(bounds[-1] + len(one))
            rates.append(rate[0])
            errors.append(error)
        return np.concatenate(frames) if frames else np.zeros((0, SIDE, SIDE), np.uint8), np.array(bounds), rates, errors


def clips(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per shot of a file: the other columns and clip, first_frame, n_frames, start_s, end_s."""
    keep = [f for f in df.schema.fields if f.name not in (media, "clip", "first_frame", "n_frames", "start_s", "end_s")]
    more = T.StructType().add("clip", "integer").add("first_frame", "integer").add("n_frames", "integer").add("start_s", "double").add("end_s", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files in _files(batches, media):
            frames, bounds, rates, _ = _loaded(files)
            begins = np.flatnonzero(shots(frames, bounds))
            ends = np.concatenate([begins[1:], [len(frames)]])[: len(begins)]
            of = np.searchsorted(bounds, begins, side="right") - 1
            clip = np.arange(len(begins)) - np.searchsorted(begins, bounds[:-1])[of]
            rate = np.array(rates)[of]
            first = begins - bounds[of]
            rows = part.select([f.name for f in keep]).take(pa.array(of))
            cols = [clip.astype(np.int32), first.astype(np.int32), (ends - begins).astype(np.int32), first / rate, (ends - bounds[of]) / rate]
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, cols)], names=[*(f.name for f in keep), *more.names])

    return df.mapInArrow(run, T.StructType([*keep, *more.fields]))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Per stored file, read back: the other columns and the payload's and file's digests, `feature`, the shots' first frames, and `error`. Columns of these names are replaced."""
    made = {"payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"}
    keep = [f for f in df.schema.fields if f.name != media and f.name not in made]
    more = (
        T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string").add("error", "string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files in _files(batches, media):
            frames, bounds, rates, errors = _loaded(files)
            begin = shots(frames, bounds)
            raw = memoryview(frames.reshape(-1))
            cols: list[list] = [[] for _ in more.names]
            for k, data in enumerate(files):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if a == b:
                    stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    for col, value in zip(cols, (None, None, None, *stored, None, errors[k])):
                        col.append(value)
                    continue
                payload = raw[a * SAMPLES : b * SAMPLES]
                cuts = np.flatnonzero(begin[a:b]).tolist()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={b - a};rate={rates[k]:g};shots={','.join(map(str, cuts))}", None)
                for col, value in zip(cols, row):
                    col.append(value)
            arrays = [pa.array(c, type=pa.string() if f.dataType.typeName() == "string" else pa.int64()) for c, f in zip(cols, more)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *arrays], names=[*(f.name for f in keep), *more.names])

    return df.mapInArrow(run, T.StructType([*keep, *more.fields]))
