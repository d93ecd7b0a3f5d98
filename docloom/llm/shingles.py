"""Hashes of words and of word shingles, worked out for many texts at once with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spread(start: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(start + 1, start + n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTES = spread(1 << 20, 256)
_STEPS = spread(1 << 21, 64)


@lru_cache(maxsize=1)
def _positions(n: int) -> np.ndarray:
    return spread(1 << 32, n)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the number of words of each text. Words: ``bytes.split()``."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for ws in split for w in ws]
    if not words:
        return np.zeros(0, U), counts
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    table = _positions(1 << max(12, int(lengths.max()).bit_length()))
    sums = np.add.reduceat(_BYTES[data] * table[place], starts)
    return mix(sums + lengths.astype(U)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``size`` words; a text with fewer words has them all as one shingle."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    parts_h, parts_o = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    if n >= size:
        total = np.zeros(n - size + 1, U)
        for k in range(size):
            total += words[k : n - size + 1 + k] * _STEPS[k]
        inside = owner[: n - size + 1] == owner[size - 1 :]
        parts_h.append(mix(total[inside]))
        parts_o.append(owner[: n - size + 1][inside])
    ends = np.cumsum(counts)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        run = words[ends[i] - counts[i] : ends[i]]
        parts_h.append(mix(np.array([int((run * _STEPS[: len(run)]).sum(dtype=U)) ^ int(_STEPS[40 + len(run)])], dtype=U)))
        parts_o.append(np.array([i]))
    return np.concatenate(parts_h), np.concatenate(parts_o)
