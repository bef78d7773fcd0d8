"""Word shingles of texts: exact sets, 64-bit hashes of them, and MinHash signatures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_set(text: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``width`` words; a shorter text is one run, an empty one none."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    runs = len(words) - width + 1
    mixed = np.full(runs, width, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * _MIX[0] + each[k : k + runs]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX[2]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    flips = rng.integers(0, 1 << 32, size=(count, 1), dtype=np.uint32)
    factors = rng.integers(0, 1 << 31, size=(count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return flips, factors


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of every shingle hash under each of ``count`` permutations."""
    flips, factors = _permutations(count)
    low = hashes.astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        turned = (low[None, at : at + 1024] ^ flips) * factors
        np.minimum(least, turned.min(axis=1), out=least)
    return least
