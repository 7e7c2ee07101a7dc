"""Words of a text as 64-bit hashes, for a whole text at once with NumPy."""

from __future__ import annotations

import numpy as np

# An odd base of the polynomial hash, its inverse mod 2^64, and the multipliers of a 64-bit finalizer.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        m = max(1 << 16, 2 * n)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _runs(white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
    return edges[0::2], edges[1::2]


def run_hashes(text: bytes, apart: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every run of bytes that don't keep runs apart; apart: true or false for each byte."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = _runs(apart[raw])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    if lower:
        raw = _LOWER[raw]
    power, inverse = _upto(len(raw))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
    return mix64((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every run of anything but ASCII white space."""
    return run_hashes(text, _WHITE, lower)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words; none if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, _ = _upto(n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * power[i + 1]
    return mix64(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of n-word shingles, lower-cased; with fewer words the whole sequence as one; none without words."""
    h, _, _ = word_hashes((text or "").encode(), lower=True)
    if len(h) and len(h) < n:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, n))
