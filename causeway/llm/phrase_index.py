"""FM-index over word numbers in both reading directions, with intervals extended on either side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of the next ``depth`` symbols; ties in text order.

    Ranks of 1, 2, 4, ... symbols are doubled; the last step takes only what is missing to ``depth``.
    Intervals of patterns up to ``depth`` symbols are the same as in a full suffix array.
    """
    rank, known = text.astype(np.int32), 1
    while True:
        step = min(known, depth - known)
        key = rank.astype(np.int64)
        if step:
            # the first ``known`` symbols, then those from ``step`` on: together the first ``known + step``;
            # past the end stands 0, which no symbol of a pattern is
            key *= int(rank.max(initial=0)) + 1
            key[:max(0, len(text) - step)] += rank[step:]
        order = np.argsort(key, kind="stable")
        if not step:
            return order
        key = key[order]
        rank = np.empty(len(text), np.int32)
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(key) else 0
        known += step
        if known == depth:
            return order


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, in suffix order; before the first stands the last."""
    return text[suffix_order(text, depth) - 1]


@dataclass
class Intervals:
    """Patterns by their places in both indexes: ``low`` of the pattern, ``back`` of its mirror, ``size`` of both."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Intervals:
        return Intervals(self.low[at], self.back[at], self.size[at])


class BothWays:
    """Index of a text of symbols 1, 2, ... whose pieces are ended by 0; the text ends with 0.

    It holds the transform of the text and that of its mirror, where extending to the right is
    extending to the left. Extending an interval in one of them moves the other along: inside it the
    extended patterns stand in the order of the new symbol.
    """

    def __init__(self, forward: np.ndarray, mirror: np.ndarray) -> None:
        self.sides = (forward, mirror)
        self.symbols = int(forward.max(initial=0)) + 1
        self.counts = np.bincount(forward, minlength=self.symbols)

    @classmethod
    def of(cls, text: np.ndarray, depth: int) -> BothWays:
        # the mirror starts with the last piece and ends with 0 as well
        mirror = np.concatenate((text[:-1][::-1], text[-1:]))
        return cls(transform(text, depth), transform(mirror, depth))

    def symbols_once(self) -> Intervals:
        """One interval per symbol 1, 2, ..., in this order."""
        start = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        return Intervals(start[1:], start[1:], self.counts[1:])

    def _steps(self, side: int) -> np.ndarray:
        """Place of each suffix after its preceding symbol is put before it."""
        last = np.empty(len(self.sides[side]), np.int64)
        last[np.argsort(self.sides[side], kind="stable")] = np.arange(len(last))
        return last

    def _extend(self, side: int, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        ends = np.cumsum(size)
        starts = ends - size
        place = np.repeat(low - starts, size) + np.arange(ends[-1] if len(ends) else 0)
        key = np.repeat(np.arange(len(size)) * self.symbols, size) + self.sides[side][place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        parent, symbol = key[first] // self.symbols, key[first] % self.symbols
        real = symbol > 0
        first, n, parent, symbol = first[real], n[real], parent[real], symbol[real]
        low = self._steps(side)[place[order[first]]]
        return parent, symbol, low, other[parent] + first - starts[parent], n

    def left(self, found: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """All extensions by one symbol before: index of the extended pattern, symbol, interval."""
        parent, symbol, low, back, n = self._extend(0, found.low, found.back, found.size)
        return parent, symbol, Intervals(low, back, n)

    def right(self, found: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """All extensions by one symbol behind."""
        parent, symbol, back, low, n = self._extend(1, found.back, found.low, found.size)
        return parent, symbol, Intervals(low, back, n)


def holder(starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Index of the interval (disjoint, sorted by start) that holds each place, or -1."""
    at = np.searchsorted(starts, places, side="right") - 1
    if not len(starts):
        return np.full(len(places), -1)
    return np.where((at >= 0) & (places < starts[at] + sizes[at]), at, -1)
