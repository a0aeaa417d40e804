"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers; fixed so that every worker and run hashes alike.
_P = 0x9E3779B97F4A7C15
_Q = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + np.uint64(seed)) | np.uint64(1)


def word_bytes(lower_only: bool) -> np.ndarray:
    """For each byte whether it belongs to a word: all but white space, or letters, digits and non-ASCII."""
    table = np.zeros(256, dtype=bool)
    if lower_only:
        table[128:] = True
        for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(a) : ord(b) + 1] = True
    else:
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += np.uint64(32)
    return mix(table * np.uint64(_Q) + np.uint64(0x5851F42D4C957F2D))


_VALUES = _lowered()
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out, step = np.ones(1, dtype=np.uint64), base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step & _MASK
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased), and where each text's words begin, n + 1 values."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = word[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _powers(n)
    total = np.cumsum(_VALUES[data] * power[:n])
    before = np.where(a > 0, total[a - 1], np.uint64(0))
    hashes = mix((total[b] - before) * inverse[a] + (b - a).astype(np.uint64))
    return hashes, np.searchsorted(a, offsets)


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words, in order, and where each text's begin.

    A text of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    counts = np.diff(starts)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    full = np.repeat(counts >= width, sizes)
    first = np.repeat(starts[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    at = first[full]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        value = value * np.uint64(_P) + hashes[at + k]
    out[full] = mix(value)
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        value = int(counts[d])
        for h in hashes[starts[d] : starts[d + 1]].tolist():
            value = (value * _Q + h) & _MASK
        out[bounds[d]] = mix(np.array([value], dtype=np.uint64))[0]
    return out, bounds


def digests(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the word sequences, as two int64 columns."""
    counts = np.diff(starts)
    n = len(hashes)
    out = []
    power, inverse = _powers(max(n, 1))
    for salt in (_P, _Q):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)) * power[:n])])
        a = np.minimum(starts[:-1], max(n - 1, 0))
        out.append(mix((total[starts[1:]] - total[starts[:-1]]) * inverse[a] + counts.astype(np.uint64) * np.uint64(salt)).view(np.int64))
    return out[0], out[1]
