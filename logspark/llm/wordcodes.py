"""Words and word hashes of many UTF-8 texts at once, with numpy on the raw bytes.

A word is a run of bytes other than space and 0x09-0x0D; as those are ASCII,
byte-wise splitting of UTF-8 equals splitting by characters.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _MULTIPLIER) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(starts, ends, hashes, first): word i is data[starts[i]:ends[i]]; text t has words first[t]:first[t+1]."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    now, before = solid[1:], solid[:-1]
    starts = np.flatnonzero(now[:n] & (~before[:n] | cut[:n]))
    ends = np.flatnonzero(before[1:] & (~now[1:] | cut[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    size = ends - starts
    inside = np.repeat(starts, size)  # begin of the word that each solid byte belongs to
    at = np.flatnonzero(solid[1:-1])
    term = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at - inside]
    begins = np.zeros(len(starts), np.int64)
    np.cumsum(size[:-1], out=begins[1:])
    return starts, ends, mix(np.add.reduceat(term, begins) + size.astype(np.uint64)), first


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (runs that cross texts are among them; the caller drops those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)
