"""Linked vectors by cross-polytope hashing (operator 9).

1. Equal vectors of a label are one node (its smallest id) with a count.
2. A hash rotates a vector by three rounds of random signs and a fast
   Hadamard transform and takes the nearest of the 2d signed axes. A table
   joins two hashes; the second-nearest axes give three more buckets that
   the vector probes. ``TABLES`` tables find a pair at the threshold with a
   probability of over 0.99.
3. Two nodes are a candidate where one's own bucket is the other's own or
   probed one. Buckets are compared in blocks of ``BLOCK`` nodes, block by
   block, as one matrix product in double precision, so a hot bucket is many
   small tasks. A pair is counted only in the first bucket that it shares,
   which both nodes' codes tell, so no pairs are written: a block gives each
   node's number of new links and the edges of its own components.

A null label, a vector that is null, empty, zero or holds null or non-finite
components links with nothing. Vectors of unlike length do not link. Rows
that repeat an id are vectors of their own that share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .wordhash import stream

COSINE = 0.93
TABLES = 6
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows of ``x``, whose width is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(x.shape)
        h *= 2
    return x


def _axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second-nearest signed axis of each row after a rotation."""
    d = x.shape[1]
    for r in range(3):
        signs = np.where(stream(d, 1000 + 3 * seed + r) >> np.uint64(63), 1.0, -1.0)
        x = hadamard(x * signs)
    size = np.abs(x)
    rows = np.arange(len(x))
    one = size.argmax(axis=1)
    size[rows, one] = -1
    two = size.argmax(axis=1)
    return tuple(2 * a + (x[rows, a] < 0) for a in (one, two))


def codes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """[row, table, 4]: the own bucket and the three probed ones. Buckets of
    different tables have different numbers."""
    width = 1 << max(1, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = np.empty((len(x), tables, 4), dtype=np.int64)
    for t in range(tables):
        (a, a2), (b, b2) = _axes(x, 2 * t), _axes(x, 2 * t + 1)
        for k, (p, q) in enumerate(((a, b), (a2, b), (a, b2), (a2, b2))):
            out[:, t, k] = (t * 2 * width + p) * 2 * width + q
    return out


def _coded(nodes: DataFrame, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch.column(1).to_pylist()]
            out = [None] * len(vectors)
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                for i, c in zip(at, codes(np.stack([vectors[i] for i in at]), tables).reshape(len(at), -1)):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "codes"])

    return nodes.select("node", "v").mapInArrow(run, "node long, codes array<long>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _unit(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The vectors ``flat[off[i]:off[i + 1]]``, none of them empty, at length 1."""
    width = np.diff(off)
    flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), off[:-1]), width)
    return flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, off[:-1])), width)


def _new_links(rows: pa.Table, cosine: float, tables: int) -> pa.RecordBatch:
    """Of whole blocks, sorted by (key, bucket, lo, hi, node): each node's new
    links and the smallest node that it reaches by them within its block."""
    key, bucket, lo, hi, node, block, copies = (rows.column(c).to_numpy() for c in ("key", "bucket", "lo", "hi", "node", "block", "copies"))
    vectors, code = rows.column("v").combine_chunks(), rows.column("codes").combine_chunks()
    off = np.append(0, np.cumsum(np.asarray(vectors.value_lengths(), dtype=np.int64)))
    flat = _unit(vectors.flatten().to_numpy(), off)
    code = code.flatten().to_numpy().reshape(len(node), tables, 4)
    cuts = _cuts(key, bucket, lo, hi)
    left, right = [], []
    for s, e in zip(cuts[:-1], cuts[1:]):
        v = flat[off[s]:off[e]].reshape(e - s, -1)
        if lo[s] == hi[s]:
            i, j = np.nonzero(np.triu(v @ v.T >= cosine, 1))
        else:
            x, y = (np.flatnonzero(block[s:e] == k) for k in (lo[s], hi[s]))
            i, j = np.nonzero(v[x] @ v[y].T >= cosine)
            i, j = x[i], y[j]
        left.append(s + i)
        right.append(s + j)
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = code[i], code[j]
    in_a, in_b = (b[:, :, :1] == a).any(axis=2), (a[:, :, :1] == b).any(axis=2)  # j's own bucket is one of i's, and so on
    first = np.where(in_a | in_b, np.arange(tables), tables).min(axis=1)
    ok = first < tables
    i, j, a, b, in_a, in_b, first = (z[ok] for z in (i, j, a, b, in_a, in_b, first))
    at, far = np.arange(len(i)), np.iinfo(np.int64).max
    shared = np.minimum(np.where(in_a[at, first], b[at, first, 0], far), np.where(in_b[at, first], a[at, first, 0], far))
    i, j = i[shared == bucket[i]], j[shared == bucket[i]]
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    root, linked = _roots(len(node), i, j), np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]]), pa.array(links[linked].astype(np.int64))],
                                      names=["node", "other", "n"])


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows equal in ``columns`` begin, and the number of rows."""
    new = np.zeros(len(columns[0]) + 1, dtype=bool)
    new[[0, -1]] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _compare(cosine: float, tables: int):
    """Over a partition sorted by block: a batch's whole blocks at once; the last
    block, which may go on, waits for the next batch. It has 2 * ``BLOCK`` rows or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            last = int(_cuts(*(rows.column(c).to_numpy() for c in ("key", "bucket", "lo", "hi")))[-2])
            rest = rows.slice(last)
            if last:
                yield _new_links(rows.slice(0, last), cosine, tables)
        if rest is not None and len(rest):
            yield _new_links(rest, cosine, tables)

    return run


def linked_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row."""
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                        F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    fits = table.where(fit)
    nodes = written(fits.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
                    .withColumn("key", F.xxhash64(F.size("v"), F.col("label"))), "nodes")
    coded = written(_coded(nodes, tables), "codes")
    entries = (coded.join(nodes.select("node", "key"), "node")
               .select("node", "key", F.posexplode("codes").alias("k", "bucket"))
               .select("node", "key", "bucket", (F.col("k") % 4 == 0).cast("int").alias("own")))
    entries = entries.groupBy("key", "bucket", "node").agg(F.max("own").alias("own"))
    size = written(entries.groupBy("key", "bucket").agg(F.count("*").alias("m"), F.sum("own").alias("o"))
                   .where("m > 1 and o > 0").select("key", "bucket", "m"), "buckets")
    many = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), many).cast("int")
    shared = (written(entries, "entries").join(size, ["key", "bucket"])
              .select("key", "bucket", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), many - 1)).alias("to"))
              .select("key", "bucket", "node", "block", F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi")))
    shared = shared.join(nodes.select("node", "v", "copies"), "node").join(coded, "node")
    blocks = shared.repartition("key", "bucket", "lo", "hi").sortWithinPartitions("key", "bucket", "lo", "hi", "node")
    found = written(blocks.mapInArrow(_compare(cosine, tables), "node long, other long, n long"), "found")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found, "node", "other")
    named = (nodes.select("label", "v", "node", "copies").join(sums, "node", "left")
             .join(comp.withColumnRenamed("id", "node"), "node", "left")
             .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component_id", "node").alias("component_id")))
    named = written(named, "named")
    out = fits.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = out.union(table.where(~fit).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
