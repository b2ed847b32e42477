"""Words and their 64-bit hashes, computed for whole Arrow batches with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as
``bytes.split()`` gives it. All texts of a batch are hashed together, about
``CHUNK`` bytes at a time, so the memory beside the batch stays bounded
also for one very long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (splitmix64's last step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_LETTER = stream(256, 11)
_LETTER[_BLANK] = 0
_LETTER_LOW = _LETTER.copy()
_LETTER_LOW[65:91] = _LETTER[97:123]
_BASE = np.uint64(0xD1342543DE82EF95)
_GRAM = stream(64, 23) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


@dataclass
class Words:
    """Words of consecutive rows: row r has words off[r] to off[r + 1]."""

    first: int
    off: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.off))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words and whether each lies in one row
        (entry i is the run that begins at word i)."""
        n = len(self.hashes)
        out = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        if not len(out):
            return out, np.zeros(0, dtype=bool)
        for j in range(k):
            out += self.hashes[j:n - k + 1 + j] * _GRAM[j]
        last = np.repeat(self.off[1:], np.diff(self.off))[:len(out)]
        return mix(out), np.arange(len(out)) + k <= last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and its offsets. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), off


def _split(b: np.ndarray, cuts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in ``b``; no word reaches over a cut."""
    global _POWERS
    ink = ~_BLANK[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[cuts] = True
    begins, stops = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    stops[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    lo = starts[0]
    at = np.arange(lo, len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    longest = int((ends - starts).max())
    if longest > len(_POWERS):
        _POWERS = _powers(longest)
    at[~ink[lo:]] = 0
    sums = np.add.reduceat(letters[b[lo:]] * _POWERS[at], starts - lo)
    return mix(sums), starts, ends


def words(texts: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of consecutive rows, at least one row and about ``chunk`` bytes at a time."""
    data, off = flat(texts)
    letters = _LETTER_LOW if lower else _LETTER
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + chunk, side="right")) - 1)
        lo, hi = int(off[row]), int(off[end])
        parts, at = [], lo
        while at < hi or not parts:
            stop = hi
            if hi - at > 2 * chunk:  # one long text: cut it at the next blank
                blank = np.flatnonzero(_BLANK[data[at + chunk:hi]])
                stop = at + chunk + int(blank[0]) if len(blank) else hi
            cuts = off[row:end + 1]
            cuts = cuts[(cuts >= at) & (cuts <= stop)] - at
            h, s, e = _split(data[at:stop], cuts, letters)
            parts.append((h, s + at, e + at))
            if stop == at:
                break
            at = stop
        h, s, e = (np.concatenate(x) for x in zip(*parts))
        yield Words(row, np.append(np.searchsorted(s, off[row:end]), len(s)), h, s, e)
        row = end
