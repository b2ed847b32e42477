"""Packing token sequences by minimum bin slack (operator 6).

Each task packs the documents of its input partition. A document gives as
many full windows as it holds; its rest goes to a pool. A window is filled
from the pool: the longest rest opens it, and subset sums over the pool's
multiset of lengths (a bitset of reachable sums, each length with its count
split into powers of two) find the fill closest to the capacity; going back
through the bitsets gives the count of each length. A pattern is used as
often as the counts allow. While documents still come, rests without a full
window wait in the pool for better partners; if the pool grows too large, the
slack of their windows is filled with a cut piece. At the end of a partition
the last rest is cut into sequences of powers of two, which need no padding.

A null text is empty and still has its end id; a null id is kept; repeated
rows are packed each on its own; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

CAPACITY = 4096
#: Rests in a task's pool, at most about 4 * CAPACITY bytes each, from which on full windows are taken from it.
POOL = 2048

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum of at most ``room``.
    ``lengths`` ascends; ``counts`` has how many there are of each."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, many = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & mask
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + many
            target -= length * many
    return out


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return replace(self, ids=self.ids[:4 * at]), replace(self, start=self.start + at, ids=self.ids[4 * at:])


class Pool:
    """Pieces shorter than a window, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.lengths: list[int] = []  # ascending
        self.by_length: dict[int, list[Piece]] = {}
        self.counts: dict[int, int] = {}

    def add(self, piece: Piece) -> None:
        if piece.length not in self.by_length:
            insort(self.lengths, piece.length)
            self.by_length[piece.length] = []
            self.counts[piece.length] = 0
        self.by_length[piece.length].append(piece)
        self.counts[piece.length] += 1
        self.size += 1

    def take(self, length: int) -> Piece:
        got = self.by_length[length].pop()
        self.counts[length] -= 1
        self.size -= 1
        if not self.counts[length]:
            del self.by_length[length], self.counts[length], self.lengths[bisect_left(self.lengths, length)]
        return got

    def pattern(self, seed: int) -> tuple[dict[int, int], int]:
        """The counts of the fullest window that holds ``seed``, and its slack."""
        self.counts[seed] -= 1
        out = best_fill(self.lengths, self.counts, self.capacity - seed)
        self.counts[seed] += 1
        out[seed] = out.get(seed, 0) + 1
        return out, self.capacity - sum(x * n for x, n in out.items())

    def windows(self, keep: int) -> Iterator[list[Piece]]:
        """Full windows; while over ``keep`` pieces are left, slack is filled with a cut piece."""
        for seed in reversed(self.lengths[:]):
            while seed in self.by_length:
                pattern, slack = self.pattern(seed)
                if slack:
                    break
                for _ in range(min(self.counts[x] // n for x, n in pattern.items())):
                    yield [self.take(x) for x, n in pattern.items() for _ in range(n)]
        while self.size > keep:
            pattern, slack = self.pattern(self.lengths[-1])
            window = [self.take(x) for x, n in pattern.items() for _ in range(n)]
            while slack and self.size:
                piece = self.take(self.lengths[-1])
                if piece.length > slack:
                    piece, tail = piece.cut(slack)
                    self.add(tail)
                window.append(piece)
                slack -= piece.length
            if slack:  # nothing is left to fill it with
                for piece in window:
                    self.add(piece)
                return
            yield window

    def rest(self) -> Iterator[list[Piece]]:
        """All that is left, cut so that every sequence is full or a power of two long."""
        window, room = [], self.capacity
        todo = [p for x in sorted(self.by_length, reverse=True) for p in self.by_length[x]]
        self.__init__(self.capacity)
        for piece in todo:
            if piece.length > room:
                head, piece = piece.cut(room)
                yield [*window, head]
                window, room = [], self.capacity
            window.append(piece)
            room -= piece.length
            if not room:
                yield window
                window, room = [], self.capacity
        left = self.capacity - room
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                piece = window.pop(0)
                if piece.length > want:
                    piece, tail = piece.cut(want)
                    window.insert(0, tail)
                out.append(piece)
                want -= piece.length
            yield out


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, capacity: int = CAPACITY,
         pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place, ids (binary, uint32 little-endian),
    sequence and offset there. ``sequence_id`` has the task's partition in its
    upper bits. No shuffle: a partition is packed where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = encoder(tokenizer, kind), np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        waiting = Pool(capacity)

        def table(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            for window in windows:
                at = 0
                for p in window:
                    rows.append((p.doc_id, p.start, p.length, p.ids, p.doc_tokens, sequence, at))
                    at += p.length
                sequence += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        done: list[list[Piece]] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoding.encode(text.as_py() or "") + end
                n = len(ids) // 4
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    done.append([Piece(name, at, ids[4 * at:4 * (at + capacity)], n)])
                if whole < n:
                    waiting.add(Piece(name, whole, ids[4 * whole:], n))
                if waiting.size >= pool:
                    done += waiting.windows(keep=pool // 2)
                if len(done) >= 256:
                    yield table(done)
                    done = []
        done += waiting.windows(keep=waiting.size)
        done += waiting.rest()
        if done:
            yield table(done)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, PIECES))
