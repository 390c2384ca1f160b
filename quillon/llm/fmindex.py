"""An FM-index over integer symbols: BWT ranks by a wavelet matrix, positions by sampled suffixes. Plain numpy."""

from __future__ import annotations

import numpy as np

from quillon.llm.common import ranges

#: Symbols of one index at most: two ranks and a position have to fit into 63 bits while suffixes are sorted.
MOST = 1 << 20
SAMPLE = 32


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling. Symbol 0 separates: each one is a symbol of its own, in text order, so
    that no comparison goes past it."""
    n = len(seq)
    apart = seq == 0
    rank = np.where(apart, np.cumsum(apart) - 1, seq.astype(np.int64) + apart.sum())
    place, h = np.arange(n, dtype=np.int64), 1
    key = rank << 20 | place
    while True:
        key.sort()
        order = key & (MOST - 1)
        key >>= 20
        dense = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if dense[-1] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:]
        key = rank << 41 | second << 20 | place
        h *= 2


class FmIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """seq: symbols 1 .. sigma with 0 as separator; the last is 0."""
        assert len(seq) <= MOST and seq[-1] == 0
        self.n = n = len(seq)
        order = suffix_array(seq)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        bwt = seq[order - 1].astype(np.int64)
        # a suffix is sampled at each SAMPLE-th place and behind each separator, so that walks never cross one
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marked, self.sample_at, self.samples = marked, np.cumsum(marked) - 1, order[marked]
        self.levels = max(1, int(sigma).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - n % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(sigma + 1)
        self.begin = self._descend(symbols, np.zeros(sigma + 1, np.int64))

    def _ones(self, depth: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[depth][word] + np.bitwise_count(self.words[depth][word] & mask)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth in range(self.levels):
            ones = self._ones(depth, at)
            at = np.where(symbol >> (self.levels - 1 - depth) & 1, self.zeros[depth] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places of the BWT."""
        return self._descend(symbol, at) - self.begin[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for depth in range(self.levels):
            ones = self._ones(depth, at)
            bit = (self.words[depth][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[depth] + ones, at - ones)
        return self.before[symbol] + at - self.begin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each phrase; phrases are right-aligned rows with 0 in front."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        going = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            going = going[phrases[going, k] > 0]
            if not len(going):
                break
            symbol = phrases[going, k].astype(np.int64)
            base = self.before[symbol]
            low[going] = base + self.rank(symbol, low[going])
            high[going] = base + self.rank(symbol, high[going])
            going = going[low[going] < high[going]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in these rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, row = np.arange(len(rows)), rows
        while len(todo):
            found = self.marked[row]
            out[todo[found]] = self.samples[self.sample_at[row[found]]] + steps
            todo, row = todo[~found], row[~found]
            if len(todo):
                row = self.back(row)
            steps += 1
        return out

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence."""
        low, high = self.search(phrases)
        return np.repeat(np.arange(len(phrases)), high - low), self.locate(ranges(low, high - low))
