"""An FM-index over a sequence of whole numbers: suffix order, wavelet matrix of the Burrows-Wheeler transform, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many places of the text, and at every start of a run, the index knows the place of a suffix.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in ascending order, by prefix doubling. Zeros part runs: each counts as a symbol of its own, below all others."""
    n = len(text)
    gap = text == 0
    first = np.where(gap, np.cumsum(gap) - 1, text.astype(np.int64) + int(gap.sum()))
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while rank.max(initial=0) < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(found[1:] != found[:-1])))
        k *= 2
    return order


class Bits:
    """A bit vector with counts of ones up to a place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Ranks of symbols and symbols of places, a level for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray):
        self.height = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[Bits] = []
        for k in reversed(range(self.height)):
            one = (symbols >> k) & 1 != 0
            self.levels.append(Bits(one))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, bits in zip(reversed(range(self.height)), self.levels, strict=True):
            ones = bits.rank(place)
            place = np.where((symbol >> k) & 1 != 0, bits.n - bits.ones + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol stands before place."""
        return self.down(symbol, place) - self.down(symbol, np.zeros_like(place))

    def at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(place), np.int64)
        for bits in self.levels:
            one = bits.get(place)
            symbol = symbol * 2 + one
            ones = bits.rank(place)
            place = np.where(one, bits.n - bits.ones + ones, place - ones)
        return symbol


class FMIndex:
    """Index of a text of positive symbols in which zeros part runs; the last symbol is a zero. Phrases hold no zeros, so none crosses runs."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        before = text[order - 1]  # of the first suffix: the zero at the end
        self.n, self.top = len(text), int(text.max(initial=0))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.top + 1))))
        self.tree = Wavelet(before)
        known = (order % SAMPLE == 0) | (before == 0)
        self.known, self.places = Bits(known), order[known]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo to hi of the suffixes that begin with each phrase (a row of symbols, `length` of them), from its last symbol back."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero((length > k) & (lo < hi))
            symbol = phrases[on, length[on] - 1 - k].astype(np.int64)
            here = symbol <= self.top
            hi[on[~here]] = lo[on[~here]]
            on, symbol = on[here], symbol[here]
            lo[on], hi[on] = self.step(symbol, lo[on]), self.step(symbol, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The place in the text of each row's suffix: back symbol by symbol to a suffix whose place is known."""
        row, place, steps = row.copy(), np.full(len(row), -1, np.int64), 0
        on = np.arange(len(row))
        while len(on):
            known = self.known.get(row[on])
            done = on[known]
            place[done] = self.places[self.known.rank(row[done])] + steps
            on = on[~known]
            row[on] = self.step(self.tree.at(row[on]), row[on])
            steps += 1
        return place
