"""Substring pairs as an equi-join (JN15).

A needle of L bytes that lies in a text brings all its grams along. Of every
``w`` neighbouring grams the one with the smallest hash is the window's anchor;
a window inside the needle is the same window in the text, so both name the
same anchor. A needle joins by one anchor, the rarest of its own, on a hash of
(block, gram size, gram); ``contains`` verifies the candidates.

Three passes keep the shuffles small. The first counts the texts' anchors in
``BUCKETS`` counters: a count is never too small, so a needle with an anchor
that has none is in no text. The second picks each needle's anchor by those
counts. The third lets a text emit only anchors that some needle picked (told by ``SLOTS`` bits; what
passes by chance finds no needle). Counters and bits have a fixed size; needles and texts stay out of the
index and meet once, for the verification.

Gram sizes are 1 to 8 bytes, 16 from 24 bytes on and 32 from 48: in prose 8 bytes are shared by many texts, and
candidates would grow with the square of the input. ``w`` follows from the shortest needle of each
size, so one pass over the texts serves all needle lengths. No needle needs a nested loop.

Frequent anchors are split: needles whose anchor is counted more than ``HOT`` times are repeated under
``SALTS`` salts and meet a share of the texts each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WIDEST = 16
BUCKETS = 1 << 21
SLOTS = 1 << 28
HOT = 10_000
SALTS = 16
_PAGE = 1 << 15  # bits of one bitmap of Spark


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes neighbours unlike."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def anchors(text: bytes, q: int, w: int) -> np.ndarray:
    """Distinct hashes of the smallest gram of ``q`` bytes in each window of ``w`` grams."""
    if len(text) - q + 1 < w:
        return np.zeros(0, dtype=np.int64)
    n = len(text) - min(q, 8) + 1
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    least = np.zeros(n, dtype=np.uint64)
    for j in range(min(q, 8)):  # up to 8 bytes fill a number, so grams are told apart exactly
        least |= b[j:n + j] << np.uint64(8 * j)
    least, have = _spread(least), 1
    for size in (8, 16):  # longer ones are hashed from two halves
        if q > size:
            least = _spread((least[:-size] << np.uint64(1)) ^ (least[:-size] >> np.uint64(63)) ^ least[size:])
    while have < w:
        step = min(have, w - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return np.unique(least).view(np.int64)


def gram_size(length: int) -> int:
    return 32 if length >= 48 else 16 if length >= 24 else min(length, 8)


def digest(text: Column) -> Column:
    """What stands for a needle in joins."""
    return F.unhex(F.sha2(text, 256))


def _keys(text: bytes, block: int, q: int, w: int) -> np.ndarray:
    """The anchors of a text or needle, told apart by block and gram size."""
    salt = _spread(np.array([block ^ q], dtype=np.int64).view(np.uint64))
    return _spread(anchors(text, q, w).view(np.uint64) ^ salt)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, bytes]]]]:
    """Batches of (..., block hash, bytes) in parts, with those two as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield part, list(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()))


def _anchor_counts(texts: DataFrame, windows: dict[int, int]) -> np.ndarray:
    """How many texts' anchors fall into each counter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(BUCKETS, dtype=np.int64), [], 0
        for _, rows in _parts(batches):
            for block, data in rows:
                for q, w in windows.items():
                    held.append((_keys(data, block, q, w) % np.uint64(BUCKETS)).astype(np.int64))
                    n += len(held[-1])
                if n > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 16):
            some = used[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    summed = texts.select("__bh", "__bytes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.uint32)
    out[summed.column("bucket").to_numpy()] = np.minimum(summed.column("n").to_numpy(), 2 ** 32 - 1)
    return out


def _picked(needles: DataFrame, windows: dict[int, int], counts) -> DataFrame:
    """``__blk, __n, __k, __hot``: the anchor of each needle; none for a needle that is in no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        for part, rows in _parts(batches):
            at, key, hot = [], [], []
            for i, (block, data) in enumerate(rows):
                q = gram_size(len(data))
                keys = _keys(data, block, q, windows[q])
                n = freq[(keys % np.uint64(BUCKETS)).astype(np.int64)]
                least = int(n.argmin())
                if n[least]:
                    at.append(i)
                    key.append(keys[least])
                    hot.append(bool(n[least] > limit))
            kept = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(hot, pa.bool_())],
                                             names=["__blk", "__n", "__k", "__hot"])

    limit = HOT
    rows = needles.select("__blk", "__n", "__bh", "__bytes")
    schema = rows.select("__blk", "__n", F.lit(0).cast("long").alias("__k"), F.lit(True).alias("__hot")).schema
    return rows.mapInArrow(run, schema).distinct()


def _bits(keys: DataFrame) -> np.ndarray:
    """One bit per slot that some key falls into."""
    slot = F.col("__k").bitwiseAND(F.lit(SLOTS - 1))
    pages = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / _PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % _PAGE).alias("bits")).collect()
    out = np.zeros((SLOTS // _PAGE, _PAGE // 8), dtype=np.uint8)
    for page, bits in pages:
        out[page] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def _held(texts: DataFrame, windows: dict[int, int], counts, bits) -> DataFrame:
    """``__h, __k, __hot``: those anchors of the texts that needles picked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, freq = bits.value, counts.value
        for part, rows in _parts(batches):
            found, at = [], []
            for i, (block, data) in enumerate(rows):
                for q, w in windows.items():
                    keys = _keys(data, block, q, w)
                    slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
                    keys = keys[(wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    found.append(keys)
                    at.append(np.full(len(keys), i, dtype=np.int64))
            if found:
                keys = np.concatenate(found)
                hot = freq[(keys % np.uint64(BUCKETS)).astype(np.int64)] > limit
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(at))), pa.array(keys.view(np.int64)), pa.array(hot)],
                                                 names=["__h", "__k", "__hot"])

    limit = HOT
    return texts.select("__h", "__bh", "__bytes").mapInArrow(run, "__h long, __k long, __hot boolean")


def substring_pairs(needles: DataFrame, texts: DataFrame, widest: int = WIDEST) -> DataFrame:
    """``__blk, __n, __b`` for each distinct needle inside a text of its block; ``__n`` is its ``digest``.

    ``needles`` has ``__blk`` and ``__s`` (repeated ones too), ``texts`` has ``__blk``, ``__b`` (any id,
    repeated ones too) and ``__t``. A null block meets nothing. An empty needle says nothing about a
    text and gives no pairs. ``widest`` bounds the windows: 1 indexes all grams, for short texts that share their beginnings.
    """
    needles = needles.where("__s != '' and __blk is not null").withColumn("__n", digest(F.col("__s")))
    texts = texts.where("__t is not null and __blk is not null")
    # at most one row for each gram size
    length = F.octet_length("__s")
    size = F.when(length >= 48, 32).when(length >= 24, 16).otherwise(F.least(length, F.lit(8)))
    shortest = needles.groupBy(size.alias("q")).agg(F.min(length).alias("n")).collect()
    windows = {r["q"]: max(1, min((r["n"] - r["q"] + 1) // 3, widest)) for r in shortest}
    if not windows:
        return needles.join(texts.limit(0).select("__blk", "__b"), "__blk").select("__blk", "__n", "__b")
    block = F.xxhash64("__blk").alias("__bh")
    texts = texts.withColumn("__h", F.xxhash64("__blk", "__t"))
    grams = texts.select("__h", block, F.col("__t").cast("binary").alias("__bytes"))
    context = texts.sparkSession.sparkContext
    counts = context.broadcast(_anchor_counts(grams, windows))
    picked = cut_lineage(_picked(needles.select("__blk", "__n", block, F.col("__s").cast("binary").alias("__bytes")), windows, counts))
    bits = context.broadcast(_bits(picked))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    picked = picked.withColumn("__salt", F.explode(salts)).drop("__hot")
    held = _held(grams, windows, counts, bits).select(
        "__h", "__k", F.when(F.col("__hot"), F.pmod("__h", F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)).alias("__salt"))
    found = picked.join(held, ["__k", "__salt"]).select("__blk", "__n", F.col("__h").alias("__ch")).distinct()
    whole = needles.groupBy("__blk", "__n").agg(F.min("__s").alias("__s"))
    found = found.join(whole, ["__blk", "__n"])
    held_in = texts.select(F.col("__blk").alias("__tblk"), "__b", "__h", "__t")
    same = (F.col("__h") == F.col("__ch")) & (F.col("__tblk") == F.col("__blk"))
    return found.join(held_in, same).where(F.contains(F.col("__t"), F.col("__s"))).select("__blk", "__n", "__b")
