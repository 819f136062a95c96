"""A compressed FM-index over word sequences: suffix order, wavelet matrix and backward search, vectorised over patterns."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of integers, one packed bit plane a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []  # words, ones before each word, zeros of the level
        now = sequence.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-packed.size % 8 + 8, dtype=np.uint8)]).view(np.uint64)
            before = np.zeros(packed.size + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.planes.append((packed, before, int(bits.size - bits.sum())))
            now = np.concatenate([now[~bits], now[bits]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` leads in the last level on the way of ``symbol``; two such places differ by the symbol's count between them."""
        for depth, (packed, before, zeros) in enumerate(self.planes):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            inside = packed[word] & ((np.uint64(1) << shift) - np.uint64(1))
            ones = before[word] + np.bitwise_count(inside)
            bit = (symbol >> (self.levels - 1 - depth)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of ``tokens`` (positive; 0 separates the pieces, and one is added at the end) for patterns of up to ``depth`` tokens.

    Suffixes are ordered by their first ``depth`` tokens at least, which is all that backward search of such patterns needs.
    """

    def __init__(self, tokens: np.ndarray, depth: int):
        tokens = np.append(tokens, 0)  # what precedes the first token is then no token of a pattern
        n, symbols = tokens.size, int(tokens.max(initial=0)) + 1
        rank, width = tokens.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth and n:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: max(0, n - width)] = rank[width:] + 1
            key = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
            if fresh.sum() == n - 1:
                break
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=symbols))])  # tokens smaller than each symbol
        self.bwt = WaveletMatrix(tokens[order - 1], symbols)
        all_symbols = np.arange(symbols, dtype=np.int64)
        self.base = self.bwt.descend(all_symbols, np.zeros(symbols, dtype=np.int64))

    def matches(self, patterns: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns``.

        Returns the matching statistics (how many last tokens of the row occur together ``least`` times or more) and, where that is the whole
        row, its interval of suffixes.  A row is dropped as soon as fewer occurrences are left.
        """
        rows, width = patterns.shape
        statistic = np.zeros(rows, dtype=np.int64)
        lo, hi = np.zeros(rows, dtype=np.int64), np.full(rows, self.order.size, dtype=np.int64)
        alive = np.arange(rows)
        for k in range(width - 1, -1, -1):
            c = patterns[alive, k]
            a = self.first[c] + self.bwt.descend(c, lo[alive]) - self.base[c]
            b = self.first[c] + self.bwt.descend(c, hi[alive]) - self.base[c]
            lo[alive], hi[alive] = a, b
            alive = alive[b - a >= least]
            statistic[alive] += 1
            if not alive.size:
                break
        return statistic, lo, hi
