"""Token files in Simple-8b coding (operator 5).

``pack``/``unpack`` code a run of ids. A 64-bit word has a selector in its
four upper bits and as many ids of one width as its other 60 bits hold, the
first id lowest. An id of over 30 bits takes a word of its own (the escape).
Ids are cut into blocks of ``BLOCK``; no word reaches over a block, and the
offset of each block's first word is stored, so blocks decode on their own
and all words of a width decode in one numpy step.

``write_tokens`` tokenizes a table and writes it in ascending ``doc_id``
order; ``read_tokens`` gives the ids of each document back, with the number
of ids in all documents before it.

Container: a Parquet folder, so that Spark's commit protocol and any store
that Spark reaches serve it. One row is a segment: documents in order, never
split, with their ids in one payload::

    part int, segment long        place: ascending (part, segment)
    start long                    ids in this part before the segment
    doc_ids array<long>, lengths array<long>
    n_ids long
    payload binary                "S8B1", u32 ids, u32 ids per block, u32 blocks,
                                  u32 first word of each block, u64 words; little-endian

Rows without text have no ids but the end id; a null ``doc_id`` is kept and
sorts first; repeated ids are kept, ordered by text; other columns are not
read. An empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

#: Ids in a word and bits of each, by selector. 0 is the escape,
#: 14 and 15 are runs of id 0.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 120, 240)
BITS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 0, 0)

BLOCK = 1024
MAGIC = b"S8B1"
#: Ids in a segment, from which on it is closed.
SEGMENT_IDS = 1 << 18

_WIDTH = np.zeros(1 << 16, dtype=np.uint8)
for _b in range(16):
    _WIDTH[1 << _b:] = _b + 1


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 0 for id 0."""
    high = ids >> np.uint32(16)
    return np.where(high > 0, _WIDTH[high & 0xFFFF] + np.uint8(16), _WIDTH[ids & 0xFFFF]).astype(np.uint8)


def _selectors(ids: np.ndarray, block: int) -> np.ndarray:
    """For each position the selector that takes most ids from there on.
    A word may lie partly beyond its block's end, where it counts as zeros."""
    n = len(ids)
    rows = -(-n // block)
    most = np.zeros((rows, block + 240), dtype=np.uint8)
    padded = np.zeros(rows * block, dtype=np.uint8)
    padded[:n] = _widths(ids)
    most[:, :block] = padded.reshape(rows, block)
    out = np.zeros((rows, block), dtype=np.uint8)  # the escape
    run, have = most.copy(), 1  # run: the widest of the next `have` ids
    order = sorted(range(1, 16), key=lambda s: COUNTS[s])
    for s in order:
        while have < COUNTS[s]:
            step = min(have, COUNTS[s] - have)
            run[:, :-step] = np.maximum(run[:, :-step], run[:, step:])
            have += step
        out[run[:, :block] <= BITS[s]] = s
    return out.reshape(-1)[:n]


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The payload of uint32 ``ids``."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return MAGIC + np.array([0, block, 0], dtype="<u4").tobytes()
    selector = _selectors(ids, block)
    jump = np.array(COUNTS, dtype=np.int64)[selector]
    begin = np.arange(blocks, dtype=np.int64) * block
    end = np.minimum(begin + block, n)
    at, live, found = begin.copy(), np.arange(blocks), []
    while len(live):
        found.append(at[live])
        at[live] += jump[at[live]]
        live = live[at[live] < end[live]]
    first = np.sort(np.concatenate(found))
    of = selector[first]
    words = of.astype(np.uint64) << np.uint64(60)
    stop = np.minimum(first + jump[first], end[first // block])
    for s in range(14):
        at = np.flatnonzero(of == s)
        for j in range(COUNTS[s]):
            if not len(at):
                break
            at = at[first[at] + j < stop[at]]
            words[at] |= ids[first[at] + j].astype(np.uint64) << np.uint64(BITS[s] * j)
    offsets = np.searchsorted(first, begin).astype("<u4")
    return MAGIC + np.array([n, block, blocks], dtype="<u4").tobytes() + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (all without these) of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, block, blocks = (int(x) for x in np.frombuffer(payload, dtype="<u4", count=3, offset=4))
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    offsets = np.frombuffer(payload, dtype="<u4", count=blocks, offset=16).astype(np.int64)
    words = np.frombuffer(payload, dtype="<u8", offset=16 + 4 * blocks)
    bounds = np.append(offsets, len(words))[first:last + 1]
    words = words[bounds[0]:bounds[-1]]
    of = (words >> np.uint64(60)).astype(np.int64)
    jump = np.array(COUNTS, dtype=np.int64)[of]
    before = np.cumsum(jump) - jump
    block_of = np.repeat(np.arange(last - first), np.diff(bounds))
    at0 = before - before[bounds[:-1] - bounds[0]][block_of] + block_of * block
    size = min(n, last * block) - first * block
    stop = np.minimum(at0 + jump, np.minimum((block_of + 1) * block, size))
    out = np.zeros(size, dtype=np.uint32)
    for s in range(14):
        at = np.flatnonzero(of == s)
        mask = np.uint64((1 << BITS[s]) - 1)
        for j in range(COUNTS[s]):
            if not len(at):
                break
            at = at[at0[at] + j < stop[at]]
            out[at0[at] + j] = ((words[at] >> np.uint64(BITS[s] * j)) & mask).astype(np.uint32)
    return out


SEGMENTS = "part int, segment long, start long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int | None = 0,
                 id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Tokenize ``docs`` and write the ids below ``path`` in ascending id order,
    each document followed by ``end_id`` (None: by nothing)."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text"))
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        ids: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []
        start = segment = size = 0

        def closed() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            row = {"part": part, "segment": segment, "start": start, "doc_ids": names, "lengths": lengths,
                   "n_ids": size, "payload": payload}
            kinds = {"part": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()),
                     "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()],
                                              names=list(row))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = encoding.encode(text.as_py() or "") + end
                ids.append(got)
                names.append(name)
                lengths.append(len(got) // 4)
                size += lengths[-1]
                if size >= segment_ids:
                    yield closed()
                    start, segment, size = start + size, segment + 1, 0
                    ids, names, lengths = [], [], []
        if names:
            yield closed()

    rows.mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (binary, uint32 little-endian) of each document in the files."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))  # a row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                begins = ends - np.array(row["lengths"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(ends), pa.int32()),
                     pa.array(begins + row["start"]), pa.array(ends - begins),
                     pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())],
                    names=["doc_id", "part", "part_at", "n_tokens", "ids"])

    rows = segments.mapInArrow(decode, "doc_id long, part int, part_at long, n_tokens long, ids binary")
    return (rows.join(F.broadcast(parts), "part")  # a row per output partition
            .select("doc_id", (F.col("part_start") + F.col("part_at")).alias("start"), "n_tokens", "ids"))
