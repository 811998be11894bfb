"""Hashes of words and of runs of words, over whole arrays at once."""

from __future__ import annotations

import numpy as np
import xxhash

_DRAWN = np.random.default_rng(51)
BYTE_VALUE = _DRAWN.integers(1, 1 << 63, 256, np.uint64)
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Odd, so that they have inverses.
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9]
#: Bytes that are hashed at a time, and from how many on a word is hashed by itself.
PIECE, LONG_WORD = 1 << 18, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        factors = np.full(n + (-n & 0xFFFF), base, np.uint64)
        factors[:1] = 1
        _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[base][:n]


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in bytes."""
    solid = np.concatenate([[False], IN_WORD[np.frombuffer(raw, np.uint8)], [False]])
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    return turns[::2], turns[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes of each word: differences of running sums, shifted to one place by the base's inverse. Works on a piece of the
    text at a time, whatever the text's length."""
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    i, stops, values = 0, [*long.tolist(), len(starts)], np.frombuffer(raw, np.uint8)
    for stop in stops:
        while i < stop:
            j = min(stop, max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right"))))
            a, b = int(starts[i]), int(ends[j - 1])
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(BYTE_VALUE[values[a:b]] * _powers(BASES[2], b - a), out=sums[1:])
            out[i:j] = mix((sums[ends[i:j] - a] - sums[starts[i:j] - a]) * _powers(pow(BASES[2], -1, 1 << 64), b - a)[starts[i:j] - a])
            i = j
        i = stop + 1
    return out


class Runs:
    """The hashes of runs of words [first, end), told by the words alone."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), len(hashes) + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Of each run of k words."""
    first = np.arange(max(len(hashes) - k + 1, 0))
    return Runs(hashes, base).of(first, first + k) if len(first) else np.zeros(0, np.uint64)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (width - size)], x[width - size :])
