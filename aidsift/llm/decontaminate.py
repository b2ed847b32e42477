"""Benchmark passages in documents, within an edit distance (operator 1).

An item of n words is found in a document where n words, more or less, are at
most K = floor(``share`` * n) word edits from it (A-Z lower-cased).

1. K edits leave one of K + 1 pieces of an item whole, so a match holds a run
   of q = ceil((n - K) / (K + 1)) words of the item (5 at most are asked for).
   Texts are searched for these runs; where none is, nothing can match. A run
   names the windows of the item's size that begin where the item would, up to
   K words off.
2. CGK embedding: a walk over the words of a window gives 3n symbols; a random
   bit of (step, word) says whether it moves on. Texts at a small edit distance
   fall into step again, so their embeddings differ in few places (Hamming).
3. Bit sampling: each repetition compares ``SAMPLE`` places of one of
   ``WALKS`` walks, ``REPEATS`` times; a window is a candidate if one key
   agrees with the item's. At half of the places differing 0.9999 are found.
4. The exact edit distance of the item and the best part of the text around
   the candidates decides.

The benchmark is read ``ITEMS`` items at a time, each part against all
documents, so what a task holds is bounded whatever the benchmark's size.
Items and documents without words match nothing; a null id is reported as
null; repeated rows are reported each once per distinct result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix, words as words_of
from .worker import text_place

SHARE = 0.15
SEED = 5
SAMPLE = 3
WALKS = 8
REPEATS = 64
ITEMS = 20_000
_FILTER = 1 << 20


def walk(words: np.ndarray, start: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings, [window, step]: 3 * max(n) symbols for the windows of ``n``
    words at ``start``; beyond a window's end the symbol is 0."""
    at, out = np.zeros(len(start), dtype=np.int64), np.zeros((len(start), 3 * int(n.max())), dtype=np.uint64)
    for step in range(out.shape[1]):
        inside = at < n
        symbol = np.where(inside, words[np.minimum(start + at, len(words) - 1)], np.uint64(0))
        out[:, step] = symbol
        at += ((mix(symbol ^ np.uint64((seed << 20) + step + 1)) >> np.uint64(63)) & inside).astype(np.int64)
    return out


def keys(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """[window, repetition]: the sampled places of windows of ``n`` words, hashed."""
    out = np.zeros((len(start), REPEATS), dtype=np.uint64)
    sizes = np.full(len(start), n)
    for w in range(WALKS):
        symbols = walk(words, start, sizes, w)
        for r in range(w, REPEATS, WALKS):
            places = mix(np.arange(1, SAMPLE + 1, dtype=np.uint64) * np.uint64(7919) + np.uint64(r * 104729)) % np.uint64(3 * n)
            key = np.full(len(start), np.uint64(r + 1))
            for p in places.astype(np.int64):
                key = mix(key ^ symbols[:, p])
            out[:, r] = key
    return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end) of the part of ``text`` nearest to ``item``: the
    smallest distance, then the first end, then the longest part."""
    cost = np.zeros(len(text) + 1, dtype=np.int64)
    begin = np.arange(len(text) + 1)
    place = np.arange(len(text) + 1)
    for k, word in enumerate(item, 1):
        up, diagonal = cost + 1, cost[:-1] + (text != word)
        new = np.append(k, np.minimum(up[1:], diagonal))
        source = np.append(begin[0], np.where(diagonal <= up[1:], begin[:-1], begin[1:]))
        # insertions: the least of new[j] + (i - j) over j <= i
        low = np.minimum.accumulate(new - place)
        took = np.maximum.accumulate(np.where(new - place == low, place, 0))
        cost, begin = low + place, source[took]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Items:
    """Items prepared for search."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], share: float):
        self.ids = [i for i, w in rows if len(w)]
        self.words = [w for _, w in rows if len(w)]
        self.edits = [int(share * len(w)) for w in self.words]
        flat = np.concatenate(self.words) if self.words else np.zeros(0, dtype=np.uint64)
        first = np.cumsum([0, *map(len, self.words)])
        self.keys: list[np.ndarray] = [np.zeros(0)] * len(self.words)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_run: dict[int, list[tuple[int, int, int]]] = {}
        for n in {len(w) for w in self.words}:
            at = [i for i, w in enumerate(self.words) if len(w) == n]
            for i, k in zip(at, keys(flat, first[at], n)):
                self.keys[i] = k
        for i, (w, k) in enumerate(zip(self.words, self.edits)):
            q = min(SEED, -(-(len(w) - k) // (k + 1)))
            for o in range(len(w) - q + 1):
                by_run.setdefault(q, []).append((int(run_hash(w[o:o + q])), i, o))
        for q, found in by_run.items():
            found.sort()
            h = np.array([f[0] for f in found], dtype=np.uint64)
            bloom = np.zeros(_FILTER, dtype=bool)
            bloom[(h & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.seeds[q] = (h, np.array([f[1] for f in found]), np.array([f[2] for f in found]), bloom)

    def candidates(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, item, word where the item would begin) of every run found."""
        out: set[tuple[int, int, int]] = set()
        for q, (h, item, offset, bloom) in self.seeds.items():
            g, ok = grams[q]
            at = np.flatnonzero(bloom[(g & np.uint64(_FILTER - 1)).astype(np.int64)] & ok)
            lo, hi = np.searchsorted(h, g[at]), np.searchsorted(h, g[at], side="right")
            many = hi - lo
            p = np.repeat(at, many)
            e = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out |= set(zip(rows[p].tolist(), item[e].tolist(), (p - offset[e]).tolist()))
        return out


def run_hash(words: np.ndarray) -> np.uint64:
    from .wordhash import Words
    z = np.zeros(len(words), dtype=np.int64)
    return Words(0, np.array([0, len(words)]), words, z, z).grams(len(words))[0][0]


def search(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, begin, end, distance) of each place of a text, in words."""
    for w in words_of(texts, lower=True):
        grams = {q: w.grams(q) for q in items.seeds}
        found: dict[tuple[int, int], list[int]] = {}
        for row, item, begin in items.candidates(grams, w.row_of()):
            found.setdefault((row, item), []).append(begin)
        for n in {len(items.words[i]) for _, i in found}:
            # all windows of this size, keyed at once
            asked = [(r, i, s) for (r, i), begins in found.items() if len(items.words[i]) == n
                     for s in sorted({b + d for b in begins for d in range(-items.edits[i], items.edits[i] + 1)})
                     if w.off[r] <= s < w.off[r + 1]]
            if not asked:
                continue
            key = keys(w.hashes, np.array([a[2] for a in asked]), n)
            near = (key == np.stack([items.keys[a[1]] for a in asked])).any(axis=1)
            groups: list[list[int]] = []  # row, item, first and last start
            for (r, i, s), ok in zip(asked, near):
                if not ok:
                    continue
                if groups and groups[-1][:2] == [r, i] and s - groups[-1][3] <= n // 2:
                    groups[-1][3] = s
                else:
                    groups.append([r, i, s, s])
            for r, i, a, b in groups:
                k = items.edits[i]
                lo, hi = max(int(w.off[r]), a - k), min(int(w.off[r + 1]), b + n + k)
                distance, begin, end = best_match(items.words[i], w.hashes[lo:hi])
                if distance <= k:
                    base = lo - int(w.off[r])
                    yield w.first + r, i, base + begin, base + end, distance


def _parts(benchmark: DataFrame, id_col: str, text_col: str, share: float) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).distinct()
    parts = max(1, -(-rows.count() // ITEMS))
    for part in range(parts):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()  # about ITEMS items
        got.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["text"] or b""))
        hashed = []
        for w in words_of(pa.array([r["text"] for r in got], pa.large_binary()), lower=True):
            hashed += [w.hashes[a:b] for a, b in zip(w.off[:-1], w.off[1:])]
        yield Items(list(zip([r["id"] for r in got], hashed)), share)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id``, ``item_id``, ``begin``, ``end`` (words, end exclusive), ``distance`` of each place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, item_id long, begin long, end long, distance long"

    def against(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[r], items.ids[i], a, b, d) for r, i, a, b, d in search(items, batch.column(1))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in schema.split(", ")])
        return run

    out = None
    for items in _parts(benchmark, item_col, item_text, share):
        part = rows.mapInArrow(against(items), schema)
        out = part if out is None else out.union(part)
    return out.distinct()


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found. Rows stay where they are."""
    width = len(docs.columns)
    at, more = text_place(docs, text_col)

    def against(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, *_ in search(items, batch.column(at))]] = False
                yield batch.select(range(width)).filter(pa.array(keep))
        return run

    for items in _parts(benchmark, item_col, item_text, share):
        docs = docs.select(*docs.columns, *more).mapInArrow(against(items), docs.schema)
    return docs
