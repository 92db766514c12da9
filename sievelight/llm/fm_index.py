"""FM-index over integer sequences: suffix array, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run keep their place; the first of a run does too.
SAMPLE = 8


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The suffix array of integers, by prefix doubling on ranks."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while n and step < n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class Bits:
    """A row of bits with ranks: 64-bit words, and the ones before each word."""

    def __init__(self, bit: np.ndarray) -> None:
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The ones before place i."""
        part = self.words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6].astype(np.int64) + np.bitwise_count(part)


class WaveletRanks:
    """Ranks of symbols in a sequence, by a wavelet tree whose levels are stored as one
    bit row each (zeros of a level first)."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels = max(1, int(largest).bit_length())
        self.ones: list[Bits] = []
        self.zeros: list[int] = []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i."""
        low = np.zeros(len(i), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            one_i, one_low = ones.rank(i), ones.rank(low)
            i = np.where(bit, zeros + one_i, i - one_i)
            low = np.where(bit, zeros + one_low, low - one_low)
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbol at place i."""
        c = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit, one_i = ones.get(i), ones.rank(i)
            i = np.where(bit, zeros + one_i, i - one_i)
            c = 2 * c + bit
        return c


class FMIndex:
    """Over runs of symbols 1..largest laid one after another; no match crosses runs."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, largest: int) -> None:
        runs, n = len(lengths), len(symbols) + len(lengths)
        self.runs, self.n = runs, n
        run = np.repeat(np.arange(runs), lengths)
        place = np.arange(len(symbols)) + run
        text = np.zeros(n, np.int64)
        text[place] = symbols
        # Run ends differ from each other, so that suffixes are told apart within their run.
        ends = np.flatnonzero(text == 0)
        unlike = text + runs
        unlike[ends] = np.arange(runs)
        order = suffix_array(unlike)
        counts = np.bincount(text, minlength=largest + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: largest + 2]
        self.tree = WaveletRanks(text[order - 1], largest)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        kept = np.zeros(n, bool)
        kept[place] = (np.arange(len(symbols)) - np.repeat(starts, lengths)) % SAMPLE == 0
        # Only sampled suffixes keep their place among the symbols.
        sampled = kept[order]
        self.sampled = Bits(sampled)
        at = order[sampled]
        self.sample = (at - np.searchsorted(ends, at)).astype(np.int32)

    def _step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self.tree.rank(c, i)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of phrases (rows of equal length), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live], hi[live] = self._step(c, lo[live]), self._step(c, hi[live])
            gone = hi[live] <= lo[live]
            hi[live[gone]] = lo[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """For each suffix its place in the symbols, walking back to a sampled suffix."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.sampled.get(rows))
        while len(left):
            rows[left] = self._step(self.tree.at(rows[left]), rows[left])
            walked[left] += 1
            left = left[~self.sampled.get(rows[left])]
        return self.sample[self.sampled.rank(rows)] + walked
