"""A compressed FM-index over word sequences: suffix order, Burrows-Wheeler transform, and a wavelet matrix.

Built and searched with numpy, many patterns at a time. An index is for one shard of bounded size.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words with a count before each word: rank in constant time, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many bits are set before each place i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol of a sequence, a level for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi, less the same offset for both."""
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            one = (symbol >> level & 1).astype(bool)
            lo1, hi1 = bits.ones(lo), bits.ones(hi)
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return lo, hi


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text in the order of what starts there, compared over `depth` symbols at least."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, done, n = np.argsort(rank, kind="stable"), 1, len(text)
    while done < depth and rank.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        done *= 2
    return order


class FMIndex:
    """Backward search over texts that are laid end to end, each closed by the symbol 0."""

    def __init__(self, texts: np.ndarray, ends: np.ndarray, depth: int, weights: np.ndarray | None = None) -> None:
        """texts: 64-bit words of all texts; ends: where each text ends in them. Matches are right up to `depth` words.

        `weights` tells how often each text counts; without it each counts once.
        """
        starts = np.concatenate([[0], ends[:-1]])
        self.shift = np.arange(len(ends))
        self.starts = starts + self.shift
        self.words, ids = np.unique(texts, return_inverse=True)
        body = np.zeros(len(texts) + len(ends), np.int64)
        mark = np.ones(len(body), bool)
        mark[ends + self.shift] = False
        body[mark] = ids + 1
        self.text = body
        self.order = suffix_order(body, depth)
        each = np.ones(len(ends), np.int64) if weights is None else weights.astype(np.int64)
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(each, np.diff(np.concatenate([[-1], ends + self.shift])))[self.order])])
        self.levels = max(1, int(len(self.words)).bit_length())
        self.bwt = WaveletMatrix(body[self.order - 1], self.levels)
        counts = np.bincount(body, minlength=len(self.words) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        zero = np.zeros(len(self.first), np.int64)
        self.base = self.bwt.ranks(np.arange(len(self.first)), zero, zero)[0]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts a symbol before each of the patterns whose suffix intervals are [lo, hi)."""
        lo, hi = self.bwt.ranks(symbol, lo, hi)
        return self.first[symbol] + lo - self.base[symbol], self.first[symbol] + hi - self.base[symbol]

    def matching(self, at: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of as many words as `length` tells from each place `at` of the indexed text.

        Returns for each its matching statistic (how many of its last words occur with a weight of `least` or more) and
        the suffix interval; a pattern stops where less weight is left.
        """
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.text))
        matched, live = np.zeros(len(at), np.int64), np.flatnonzero(length > 0)
        while len(live):
            a, b = self.step(self.text[at[live] + length[live] - 1 - matched[live]], lo[live], hi[live])
            enough = self.weight[b] - self.weight[a] >= least
            live = live[enough]
            lo[live], hi[live] = a[enough], b[enough]
            matched[live] += 1
            live = live[matched[live] < length[live]]
        return matched, lo, hi
