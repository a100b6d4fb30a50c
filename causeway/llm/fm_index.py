"""FM-index over integer sequences: backward search, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that is a prefix of another one comes first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:max(0, n - width)] = rank[width:]
        keys = rank * (n + 2) + second
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        steps = np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        if n == 0 or rank[order[-1]] == n:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols below ``2**levels``, by one bit vector with running counts for each level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros, self.ones = levels, [], []
        current = symbols.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(bit) - int(bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at`` (arrays, element by element)."""
        low, high = np.zeros_like(at), at.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit, ones = (symbol >> level) & 1, self.ones[k]
            low = np.where(bit == 1, self.zeros[k] + ones[low], low - ones[low])
            high = np.where(bit == 1, self.zeros[k] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its rank there."""
        symbol, low, pos = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[pos + 1] - ones[pos]
            symbol = symbol * 2 + bit
            low = np.where(bit == 1, self.zeros[k] + ones[low], low - ones[low])
            pos = np.where(bit == 1, self.zeros[k] + ones[pos], pos - ones[pos])
        return symbol, pos - low


class FMIndex:
    """Index of a sequence of integers from 1 to ``largest``; an end symbol 0 is added."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.concatenate((text.astype(np.int64), [0]))
        suffixes = suffix_array(text)
        self.wavelet = WaveletTree(text[suffixes - 1], max(1, int(largest).bit_length()))
        counts = np.bincount(text, minlength=largest + 1)
        self.before = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        sampled = suffixes % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled, dtype=np.int64)))
        self.samples = suffixes[sampled]
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns (one row each); empty where low == high."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: step back until a sampled position is met."""
        found, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            hit = self.sample_rank[here + 1] > self.sample_rank[here]
            found[open_[hit]] = self.samples[self.sample_rank[here[hit]]] + steps
            open_, here = open_[~hit], here[~hit]
            if len(open_):
                symbol, rank = self.wavelet.access(here)
                rows[open_] = self.before[symbol] + rank
            steps += 1
        return found
