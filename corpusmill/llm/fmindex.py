"""A compressed FM-index over integer symbols: bit-packed wavelet matrix over the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; ``ranks`` are dense from 0, and some symbol ends every repeat."""
    n, k = len(ranks), 1
    rank = ranks.astype(np.uint64)
    while True:
        after = np.zeros(n, np.uint64)
        after[: n - k if k < n else 0] = rank[k:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]).astype(np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= 2 * n:
            return order


class WaveletMatrix:
    """Rank over a sequence of symbols below ``2 ** levels``, one packed bit vector and its counts a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        current = symbols
        for level in range(levels - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.words.append(packed)
            self.counts.append(ones.astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the equal symbols, counted over the whole sorted sequence."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """Index of several sequences, each closed by a separator; symbols are any unsigned integers.

    ``matching_statistics`` searches backwards over the wavelet matrix, many positions at a time.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        n, m = len(symbols) + len(lengths), len(lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text = np.zeros(n, np.int64)  # 0 is the separator
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        text[inside] = codes + 1
        ranks = text + m - 1
        ranks[~inside] = np.arange(m)  # separators differ, so no repeat runs beyond its sequence
        self.order = suffix_array(ranks)
        self.text = text
        bwt = text[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.matrix = WaveletMatrix(bwt, max(1, int(len(self.alphabet)).bit_length()))
        self.zero = self.matrix.walk(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.walk(symbol, at) - self.zero[symbol]

    def matching_statistics(self, ends: np.ndarray, most: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text position the longest match of at most ``most`` symbols that ends before it and stands in
        ``least`` places or more: its length, and the interval of the suffix order that holds these places.

        All positions are searched backwards at once; one is dropped when fewer places are left.
        """
        length = np.zeros(len(ends), np.int64)
        best_lo, best_hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        which = np.arange(len(ends))
        lo, hi = best_lo, best_hi
        for back in range(1, most + 1):
            symbol = self.text[ends[which] - back]
            if back == 1:
                lo, hi = self.first[symbol], self.first[symbol + 1]
            else:
                lo, hi = self.step(symbol, lo), self.step(symbol, hi)
            keep = (hi - lo >= least) & (symbol > 0)
            which, lo, hi = which[keep], lo[keep], hi[keep]
            if not len(which):
                break
            length[which], best_lo[which], best_hi[which] = back, lo, hi
        return length, best_lo, best_hi
