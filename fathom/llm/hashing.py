"""Vectorised 64-bit hashing of tokens and of runs of successive tokens."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29, _S32 = np.uint64(31), np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S31)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


class TokenHasher:
    """Hashes of strings with a memo that is emptied before it grows past ``limit`` entries."""

    def __init__(self, limit: int = 300_000):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` successive token hashes; empty if there are fewer tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(h[:n])
    for i in range(1, width):
        out = mix(out + h[i : n + i])
    return out
