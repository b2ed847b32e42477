"""Resampling towards a target distribution (operator 11).

Words are runs of digits, ``a``-``z`` (after lowering ``A``-``Z``) and all bytes from
0x80 on. Features are single words and pairs of neighbours; a feature's bucket is
the CRC-32 of its bytes modulo ``BUCKETS``. Documents whose features are likelier
under the target table than under all documents get larger weights, and a draw
without replacement adds Gumbel noise of the id to the weight.

An Aho-Corasick automaton holds distinct words of the corpus, each between two
delimiters, so it matches whole words alone; the payload of a match is the
word's CRC and length. CRC-32 is linear: the CRC of a pair follows from the
payloads of two neighbours (``compose``), so no pair is ever built as a string.

The automaton holds the most frequent words of up to ``MAX_WORD`` bytes, ``max_words``
at most, which bounds its memory in a task. A word outside it gets
its payload from its bytes: buckets are exact for every word at any size.

* A null or empty text has no features: weight 0, never drawn.
* A null id draws with the empty string as its id, after all others of its score.
* Repeated rows each count and are each drawn on their own.
* Very long texts are scanned in segments cut between words.
* Empty tables give no rows; an empty target gives gains from t = T = 0.
* Further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

BUCKETS = 10_000
MAX_WORDS = 100_000
MAX_WORD = 64
SEGMENT = 1 << 20
HELD_WORDS = 500_000  # distinct words that a task counts before it passes them on

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Lowers A-Z and makes every byte outside words a blank.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if _IN_WORD[c] else 32 for c in range(256))
_BLANK_CRC = zlib.crc32(b" ")


def _shift_tables(n: int) -> np.ndarray:
    """Tables [4][256] that carry a CRC over ``n`` further bytes: CRC(a + b) is the carried CRC(a) xor CRC(b)."""
    zeros, out = bytes(n), np.zeros((4, 256), dtype=np.uint32)
    # the map is linear: its images of the 32 single bits give all others by xor
    plain = zlib.crc32(zeros)
    image = [zlib.crc32(zeros, 1 << bit) ^ plain for bit in range(32)]
    for byte in range(4):
        for bit in range(8):
            step = 1 << bit
            out[byte, step:2 * step] = out[byte, :step] ^ np.uint32(image[8 * byte + bit])
    return out


class _Shift:
    """Shift tables by length: short lengths in one array, longer ones as they come."""

    def __init__(self, short: int = MAX_WORD + 1):
        self.tables = np.stack([_shift_tables(n) for n in range(short + 1)])

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        near = lengths < len(self.tables)
        n = np.where(near, lengths, 0)
        out = np.zeros(len(crcs), dtype=np.uint32)
        for byte in range(4):
            out ^= self.tables[n, byte, (crcs >> np.uint32(8 * byte)) & np.uint32(255)]
        for i in np.flatnonzero(~near):
            # a rare, long word: carry this one CRC over its length
            out[i] = zlib.crc32(bytes(int(lengths[i])), int(crcs[i])) ^ zlib.crc32(bytes(int(lengths[i])))
        return out


_SHIFT: _Shift | None = None


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of ``first + ' ' + second`` from the words' CRCs and the second's length."""
    global _SHIFT
    if _SHIFT is None:
        _SHIFT = _Shift()
    blank = _SHIFT(first, np.ones(len(first), dtype=np.int64)) ^ np.uint32(_BLANK_CRC)
    return _SHIFT(blank, length) ^ second


class Dictionary:
    """The automaton of delimiter-bounded words and their payloads."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # a match emits its payload's place in these arrays
        self.crcs = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        for i, word in enumerate(words):
            # bytes as the characters 0-255, so that offsets are byte offsets
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        self.built = len(self.automaton) > 0
        if self.built:
            self.automaton.make_automaton()

    def payloads(self, segment: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and end of every word of a normalised segment, in order."""
        ink = np.frombuffer(segment, dtype=np.uint8) != 32
        edge = np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        crcs, lengths, known = np.zeros(len(ends), dtype=np.uint32), ends - starts, np.zeros(len(ends), dtype=bool)
        if self.built and len(ends):
            text = f" {segment.decode('latin-1')} "
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
            # a match ends at the blank behind its word, one place on for the blank put in front
            at = np.searchsorted(ends, found[:, 0] - 1)
            crcs[at], lengths[at], known[at] = self.crcs[found[:, 1]], self.lengths[found[:, 1]], True
        for i in np.flatnonzero(~known):
            crcs[i] = zlib.crc32(segment[starts[i]:ends[i]])
        return crcs, lengths, ends


def _segments(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first row, rows, normalised bytes) of about ``SEGMENT`` bytes: whole short texts
    joined by blanks, or a part of one long text (rows 1) that ends between words."""
    row = 0
    while row < len(texts):
        if len(texts[row]) > SEGMENT:
            text, at = texts[row].translate(LETTERS), 0
            while at < len(text):
                stop = text.find(b" ", at + SEGMENT)
                stop = len(text) if stop < 0 else stop
                yield row, 1, text[at:stop]
                at = stop
            row += 1
            continue
        end, size = row, 0
        while end < len(texts) and len(texts[end]) <= SEGMENT and size <= SEGMENT:
            size += len(texts[end]) + 1
            end += 1
        yield row, end - row, b" ".join(texts[row:end]).translate(LETTERS)
        row = end


def features(texts: list[bytes], words: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and all features' buckets with their rows."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    rows, buckets, last = [], [], None
    for first, n, segment in _segments(texts):
        crcs, lengths, ends = words.payloads(segment)
        bounds = np.cumsum([len(t) + 1 for t in texts[first:first + n]]) if n > 1 else np.array([len(segment) + 1])
        row = first + np.searchsorted(bounds, ends, side="right")
        np.add.at(n_words, row, 1)
        if last is not None and len(row) and last[0] == row[0]:  # goes on with a long text
            row, crcs, lengths = (np.concatenate([[a], b]) for a, b in zip(last, (row, crcs, lengths)))
            crcs = crcs.astype(np.uint32)
            single = slice(1, None)
        else:
            single = slice(0, None)
        near = np.flatnonzero(row[1:] == row[:-1])
        pairs = compose(crcs[near], crcs[near + 1], lengths[near + 1])
        rows += [row[single], row[near]]
        buckets += [crcs[single] % np.uint32(BUCKETS), pairs % np.uint32(BUCKETS)]
        last = (row[-1], crcs[-1], lengths[-1]) if len(row) else last
    if not rows:
        return n_words, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return n_words, np.concatenate(rows).astype(np.int64), np.concatenate(buckets).astype(np.int64)


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, about two segments of bytes (or one text) at a time."""
    col, at, out, size = batch.column(column), 0, [], 0
    for i in range(len(col)):
        text = col[i].as_buffer()
        out.append(text.to_pybytes() if text is not None else b"")
        size += len(out[-1])
        if size > 2 * SEGMENT:
            yield at, out
            at, out, size = i + 1, [], 0
    if out:
        yield at, out


def _bytes(df: DataFrame, text_col: str, *more):
    return df.select(F.col(text_col).cast("string").cast("binary").alias("text"), *more)


def vocabulary(texts: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> list[bytes]:
    """The most frequent words of at most ``MAX_WORD`` bytes: all whose count reaches a level that ``max_words`` words at most reach.

    The level comes from a histogram of counts, so no more than ``max_words`` words
    ever leave the executors.
    """
    def rows(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        seen = Counter()
        for batch in batches:
            for _, part in _batches(batch, 0):
                for text in part:
                    seen.update(w for w in text.translate(LETTERS).split() if len(w) <= MAX_WORD)
                if len(seen) > HELD_WORDS:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    counted = _bytes(texts, text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1").withColumn("level", F.floor(F.log2("n") * 8)), "words")
    level, total = None, 0
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > max_words:
            break
        level = r["level"]
    return [] if level is None else sorted(bytes(r["word"]) for r in counted.where(F.col("level") >= level).select("word").collect())


_LOADED: dict[str, Dictionary] = {}


def _dictionary(key: str, words) -> Dictionary:
    """The automaton, built once per Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Dictionary(words.value)
    return _LOADED[key]


def bucket_counts(texts: DataFrame, text_col: str, words, key: str) -> np.ndarray:
    """How many features of all texts lie in each bucket; one vector leaves each task."""
    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, part in _batches(batch, 0):
                total += np.bincount(features(part, _dictionary(key, words))[2], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in _bytes(texts, text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    S, T = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (S + BUCKETS) / ((a + 1.0) * (T + BUCKETS)))) for a, b in zip(s.tolist(), t.tolist())],
                    dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = 25, min_words: int = 20, seed: int = 7, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank`` of each document.

    Of the N documents with ``min_words`` words or more the floor(percent * N / 100)
    with the highest scores are drawn, ties to the smaller id; ``rank`` counts them
    from 1 and is null for the rest. The draw sorts narrow rows over all
    partitions; no group and no rank is computed in one task.
    """
    spark = docs.sparkSession
    both = _bytes(docs, text_col).union(_bytes(target, target_text))
    words = spark.sparkContext.broadcast(vocabulary(both, "text", max_words))
    key = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, words, key), bucket_counts(target, target_text, words, key)))

    def weigh(batches):
        for batch in batches:
            for at, part in _batches(batch, 0):
                n, rows, buckets = features(part, _dictionary(key, words))
                sums = np.zeros(len(part), dtype=np.int64)
                np.add.at(sums, rows, gain.value[buckets])
                size = n + np.maximum(n - 1, 0)
                weight = np.where(size > 0, sums // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(part)), pa.array(n), pa.array(size), pa.array(weight)],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8),
               16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    weighed = _bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    enough = F.col("n_words") >= min_words
    ranked = scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    # the id of a row names its partition (upper bits) and its place there
    ranked = written(ranked.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition, so the broadcast does not grow with the rows
    offsets = sizes.select("part", before.alias("before"))
    n_enough = ranked.count()
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    columns = ["doc_id", "n_features", "n_words", "weight", "score"]
    drawn = ranked.join(F.broadcast(offsets), part == F.col("part")).select(
        *columns, F.when(rank <= percent * n_enough // 100, rank).alias("rank"))
    return drawn.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
