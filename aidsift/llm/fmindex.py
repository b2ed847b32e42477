"""A compressed FM-index over words, with matching statistics for many streams at once.

The Burrows-Wheeler transform of a shard's texts is kept as a wavelet matrix:
one packed bit vector with a rank directory for each bit of the alphabet. All
queries are numpy operations over arrays of positions.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.shifts = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        for shift in self.shifts:
            bit = (symbols >> shift) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = np.zeros(sigma, dtype=np.int64)
        self.base = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(c, i) - self.base[c]


class FMIndex:
    """Over ``texts`` (arrays of word hashes), each with an integer ``owner``.

    ``window`` is the match length that is reported; matches are followed up
    to it."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        self.words, ids = np.unique(flat, return_inverse=True)
        n = self.n = len(flat) + len(texts)
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(n, dtype=np.int64)  # 0 ends each text
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        symbols[inner] = ids + 1
        sa, ranks = self._suffixes(symbols, ends)
        lcp = self._common(sa, ranks)
        del ranks
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.words) + 1))[:-1]])
        self.bwt = WaveletMatrix(symbols[sa - 1], len(self.words) + 1)
        self._parents(lcp)
        whole = np.flatnonzero(lcp[:-1] < window)
        self.group = np.cumsum(lcp[:-1] < window) - 1  # rows that share `window` words
        owner = np.repeat(np.asarray(owners, dtype=np.int64), sizes + 1)[sa]
        self.least = np.minimum.reduceat(owner, whole)
        short = np.flatnonzero(lcp < window - 1)  # to go back to a match of window - 1
        self.short_lo = short[np.searchsorted(short, np.arange(n), side="right") - 1]
        self.short_hi = short[np.searchsorted(short, np.arange(n), side="right")]

    @staticmethod
    def _suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array by prefix doubling, and the ranks of each doubling.
        Ends of texts differ, in the order of the texts."""
        n = len(symbols)
        rank = symbols + len(ends)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1]
        ranks, step = [rank.astype(np.int32)], 1
        while True:
            key = rank.astype(np.int64) * (n + 1)
            key[:-step] += rank[step:] + 1
            sa = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            rank = np.empty(n, dtype=np.int64)
            rank[sa] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                return sa, ranks
            ranks.append(rank.astype(np.int32))

    def _common(self, sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common words of neighbours in the suffix array, up to the window; -1 at both ends."""
        n = self.n
        a, b, out = sa[:-1].copy(), sa[1:].copy(), np.zeros(n - 1, dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            r = ranks[level]
            same = (a < n) & (b < n)
            same[same] = r[a[same]] == r[b[same]]
            out[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        return np.concatenate([[-1], np.minimum(out, self.window), [-1]])

    def _parents(self, lcp: np.ndarray) -> None:
        """The nearest smaller common length before and after each row."""
        n = len(lcp)
        self.lcp = lcp
        self.before, self.after = np.zeros(n, dtype=np.int64), np.full(n, n - 1, dtype=np.int64)
        for level in np.unique(lcp)[1:]:
            smaller, here = np.flatnonzero(lcp < level), np.flatnonzero(lcp == level)
            at = np.searchsorted(smaller, here)
            self.before[here], self.after[here] = smaller[at - 1], smaller[at]

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, -1 for words that the index lacks."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, -1)

    def statistics(self, streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of the streams, one after the other: the longest match that
        begins there (up to the window), and the least owner of a whole window (else -1)."""
        sizes = np.array([len(s) for s in streams])
        symbol = self.symbols_of(np.concatenate(streams))
        first = np.cumsum(sizes) - sizes
        length, least = np.zeros(len(symbol), dtype=np.int64), np.full(len(symbol), -1, dtype=np.int64)
        at = first + sizes - 1
        sp, ep, m = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), self.n, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        live = np.flatnonzero(at >= first)
        while len(live):
            lo, hi, k = sp[live], ep[live], m[live]
            full = k == self.window
            hi, lo, k = np.where(full, self.short_hi[np.minimum(lo, self.n - 1)], hi), np.where(full, self.short_lo[np.minimum(lo, self.n - 1)], lo), k - full
            c = symbol[at[live]]
            known = np.maximum(c, 0)
            new_lo, new_hi = self.counts[known] + self.bwt.rank(known, lo), self.counts[known] + self.bwt.rank(known, hi)
            longer = (c > 0) & (new_lo < new_hi)
            done = longer | (k == 0) | (c < 0)
            # shorten: to the parent interval
            left, right = self.lcp[lo], self.lcp[hi]
            row = np.where(left >= right, lo, hi)
            q = np.maximum(self.lcp[row], 0)
            up_lo, up_hi = np.where(q > 0, self.before[row], 0), np.where(q > 0, self.after[row], self.n)
            reset = ~longer & (c < 0)
            sp[live] = np.where(longer, new_lo, np.where(reset, 0, up_lo))
            ep[live] = np.where(longer, new_hi, np.where(reset, self.n, up_hi))
            m[live] = np.where(longer, k + 1, np.where(reset, 0, q))
            moved = live[done]
            length[at[moved]] = m[moved]
            whole = moved[m[moved] == self.window]
            least[at[whole]] = self.least[self.group[sp[whole]]]
            at[moved] -= 1
            live = live[at[live] >= first[live]]
        return length, least
