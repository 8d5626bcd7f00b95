"""A small FM-index over words: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(packed.size // 8 + 2, np.uint64)
        self.words.view(np.uint8)[: packed.size] = packed
        self.before = np.zeros(self.words.size, np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Ranks of symbols in a sequence: a level for each bit, zeros first."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.depth - 1, -1, -1):
            bit = (seq >> b) & 1
            self.levels.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(int(bit.size - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            r = level.rank1(np.concatenate([start, lo, hi])).reshape(3, -1)
            at = np.stack([start, lo, hi])
            start, lo, hi = np.where(one, zeros + r, at - r)
        return lo - start, hi - start


def suffix_order(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a sequence whose suffixes differ within ``longest`` symbols, by doubling, and each position's rank."""
    rank = text.astype(np.int64)
    span = 1
    while True:
        nxt = np.zeros_like(rank)
        nxt[: -span or None] = rank[span:] + 1 if span < rank.size else 0
        key = rank * (rank.max() + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.zeros_like(rank)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, span = new, span * 2
        if rank[order[-1]] == rank.size - 1 or span > 2 * longest:
            return order, rank


class FMIndex:
    """Index of several word sequences, each followed by a separator of its own (symbols 0 .. k-1; words come after)."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        k = len(sequences)
        text = np.concatenate([np.append(s + k, i) for i, s in enumerate(sequences)]).astype(np.int64)
        self.shift, self.window = k, window
        longest = max(s.size for s in sequences) + 1
        sa, rank = suffix_order(text, longest)
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])  # where each symbol's suffixes start
        self.bwt = Wavelet(text[sa - 1], sigma)
        # runs of suffixes that share their first `window` words, and one word less: what dropping the last word of a match widens to
        lcp = self._lcp(text, sa, rank)
        self.owner = np.repeat(np.arange(k), [s.size + 1 for s in sequences])[sa]
        self.full = np.flatnonzero(np.append(True, lcp[1:] < window))
        self.less = np.flatnonzero(np.append(True, lcp[1:] < window - 1))
        self.size = text.size

    def _lcp(self, text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, counted to ``window`` words."""
        lcp = np.zeros(sa.size, np.int32)
        open_ = np.arange(1, sa.size)
        for d in range(self.window):
            a, b = sa[open_] + d, sa[open_ - 1] + d
            inside = (a < text.size) & (b < text.size)
            same = inside & (text[np.minimum(a, text.size - 1)] == text[np.minimum(b, text.size - 1)])
            open_ = open_[same]
            if not open_.size:
                break
            lcp[open_] += 1
        return lcp

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffixes that start with ``symbol`` followed by a match in [lo, hi)."""
        a, b = self.bwt.ranks(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def widen(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes that share ``window`` - 1 words with the one at ``lo``."""
        run = np.searchsorted(self.less, lo, side="right") - 1
        ends = np.append(self.less, self.size)
        return self.less[run], ends[run + 1]

    def window_matches(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For every sequence and window start: the first rank of the window's suffixes, or -1 if it doesn't occur.

        Matching statistics from right to left, cut at ``window``: a full match is widened to one word less and extended by one word to the
        left. Where that fails, no window that ends there holds the word, so the search starts anew from one word further left.
        All sequences advance together.
        """
        w, sigma = self.window, self.first.size - 1
        sizes = np.array([s.size for s in sequences], np.int64)
        offset = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.zeros(0, np.int64), *sequences]).astype(np.int64) + self.shift
        results = np.full(flat.size, -1, np.int64)
        live = sizes >= w
        begin, right = offset[live], (offset + sizes)[live]
        lo, hi, length = np.zeros(begin.size, np.int64), np.full(begin.size, self.size, np.int64), np.zeros(begin.size, np.int64)
        while begin.size:
            pos = right - length - 1
            symbol = flat[pos]
            known = symbol < sigma
            a, b = self.back(np.where(known, symbol, 0), lo, hi)
            ok = known & (b > a)
            length = np.where(ok, length + 1, 0)
            right = np.where(ok, right, np.where(known, right - 1, pos))
            lo, hi = np.where(ok, a, 0), np.where(ok, b, self.size)
            full = length == w
            if full.any():
                results[pos[full]] = lo[full]
                lo[full], hi[full] = self.widen(lo[full])
                length[full] = w - 1
                right[full] -= 1
            left = right - begin >= w
            if not left.all():
                begin, right, lo, hi, length = begin[left], right[left], lo[left], hi[left], length[left]
        return [results[o: o + max(0, n - w + 1)] for o, n in zip(offset, sizes)]
