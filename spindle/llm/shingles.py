"""Words and word shingles as 64-bit hashes, for the operators that compare texts by them."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 150_000
#: Odd 64-bit multipliers: one for each place of a shingle (powers of the first), two that finish a hash.
PLACE, MIX1, MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
UNPLACE = pow(PLACE, -1, 1 << 64)  # its inverse


def powers(n: int, base: int = PLACE) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The words between ASCII white space (bytes 9-13 and 32), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(found: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    if h.size < n:
        return h[:0]
    total, weight = np.zeros(h.size - n + 1, dtype=np.uint64), 1
    for k in range(n):
        total += h[k : h.size - n + 1 + k] * np.uint64(weight)
        weight = weight * PLACE % (1 << 64)
    return mix(total)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if h.size else h


def shingle_set(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Distinct shingles of ``n`` words in lower case (A-Z only), sorted; a shorter text is one shingle, an empty one has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = hashed(found, cache)
    if 0 < h.size < n:
        return windows(h, h.size) ^ np.uint64(h.size)
    return distinct(windows(h, n))
