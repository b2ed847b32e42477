"""Repeated windows of words, found by FM-indexes of text shards (operator 4).

A window is ``window`` consecutive words of one document. Each word that a
window covers whose words also begin in a document with a smaller id is
removed; windows are judged on the input.

1. Documents of equal words are one text (its smallest id); every window of
   its other copies is repeated.
2. The least hash of the five-word runs in a window is its anchor, so equal
   windows have equal anchors. Consecutive windows with one anchor are a
   segment. Anchors that only one document has are dropped by counting.
3. Segments of equal words are one (with their smallest id). Shards by anchor
   get an FM-index of their segments; all segments of the shard are streamed
   against it, and the matching statistics tell for each window the smallest id
   that has it.
4. An anchor with over ``HOT`` different segments is not sent to one shard:
   its windows are keyed by the hash of all their words, those of one document
   are dropped, and the rest go to shards by that key.
5. Flags of the windows meet the texts again by document.

A null text has no words; a null id takes no part and keeps all its words.
Rows that repeat an id are judged each on its own against smaller ids. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .store import written
from .wordhash import Words, flat, mix, words as words_of

WINDOW = 50
ANCHOR = 5
HOT = 2000
#: Words of segments that a shard has on average.
SHARD_WORDS = 400_000

_PLACE = np.uint64((1 << 30) - 1)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a sequence of words."""
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    a = np.add.reduce(mix(hashes ^ mix(at))) + np.uint64(len(hashes))
    b = np.add.reduce(mix(hashes * np.uint64(3) + mix(at ^ np.uint64(1 << 50))))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _running(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    have = 1
    while have < size and len(x):
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (as a word of ``w``), number of windows and anchor hash
    of each run of windows with one anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(w.hashes) < window:
        return none, none, none, none.astype(np.uint64)
    grams, _ = w.grams(ANCHOR)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_running(key, window - ANCHOR + 1) & _PLACE).astype(np.int64)
    rows = w.row_of()[:len(place)]
    inside = np.arange(len(place)) + window <= w.off[1:][rows]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(place[at]) != 0) | (np.diff(rows[at]) != 0)
    first = np.flatnonzero(new)
    return rows[at[first]], at[first], np.diff(np.append(first, len(at))), grams[place[at[first]]]


SEGS = "array<struct<h:long,s:int,k:int>>"


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id``, ``t1``, ``t2`` (of the words), ``n``, ``segs`` of each row."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int32()), ("k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(1)):
                row, first, many, anchor = segments(w, window)
                sig = [signature(w.hashes[a:b]) for a, b in zip(w.off[:-1], w.off[1:])]
                values = pa.StructArray.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array((first - w.off[row]).astype(np.int32)), pa.array(many.astype(np.int32))], names=["h", "s", "k"])
                off = pa.array(np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), pa.array([s[0] for s in sig], pa.int64()), pa.array([s[1] for s in sig], pa.int64()),
                     pa.array(np.diff(w.off).astype(np.int64)), pa.ListArray.from_arrays(off, values).cast(kind)], names=["doc_id", "t1", "t2", "n", "segs"])

    return rows.mapInArrow(run, f"doc_id long, t1 long, t2 long, n long, segs {SEGS}")


def _texts(rows: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """The words (as text) of the segments in ``lists`` (doc_id, t1, segs of h, s, k, hot);
    those of a hot anchor window by window."""
    names = ["h", "doc_id", "t1", "s", "k", "c1", "c2", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t1, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            data, _ = flat(batch.column(1))
            for w in words_of(batch.column(1)):
                out: list[tuple] = []
                for r in range(w.rows):
                    lo, hi = int(w.off[r]), int(w.off[r + 1])
                    hashes = w.hashes[lo:hi]
                    if signature(hashes)[0] != t1[w.first + r]:
                        continue  # another row with this id
                    for seg in lists[w.first + r]:
                        spans = [(seg["s"] + i, 1) for i in range(seg["k"])] if seg["hot"] else [(seg["s"], seg["k"])]
                        for s, k in spans:
                            a, b = s, s + k + window - 1
                            c1, c2 = signature(hashes[a:b])
                            out.append((c1 if seg["hot"] else seg["h"], ids[w.first + r], t1[w.first + r], s, k, c1, c2,
                                        data[w.starts[lo + a]:w.ends[lo + b - 1]].tobytes()))
                kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    joined = rows.join(lists, "doc_id").select("doc_id", "text", "t1", "segs")
    return joined.mapInArrow(run, "h long, doc_id long, t1 long, s int, k int, c1 long, c2 long, words binary")


def _searched(window: int):
    """Of one shard (c1, c2, least, words of each segment): the smallest owner of each window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, at = [], 0
        for w in words_of(pa.array(pdf.words, pa.large_binary())):
            texts += [w.hashes[a:b] for a, b in zip(w.off[:-1], w.off[1:])]
        index = FMIndex(texts, pdf.least.to_numpy(), window)
        _, least = index.statistics(texts)
        owners = []
        for t in texts:
            owners.append(least[at:at + len(t) - window + 1].tolist())
            at += len(t)
        return pd.DataFrame({"c1": pdf.c1, "c2": pdf.c2, "owners": owners})

    return run


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``text`` (bytes) and ``flags``: per signature ``t1`` of the row's words whether it is
    a copy and the windows that begin in a smaller id."""
    rows = _input(docs, id_col, text_col)
    table = written(_anchored(rows, window), "anchored")
    long = table.where(f"n >= {window} and doc_id is not null")
    texts = written(long.groupBy("t1", "t2", "n").agg(F.min("doc_id").alias("rep")), "texts")
    long = written(long.join(texts, ["t1", "t2", "n"]).select("doc_id", "t1", (F.col("doc_id") != F.col("rep")).alias("copy"), "segs").distinct(), "long")

    single = long.where("not copy").select("doc_id", "t1", F.explode("segs").alias("g")).select("doc_id", "t1", "g.*")
    anchors = single.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("m")).where("a < b")
    anchors = written(anchors.select("h", (F.col("m") > hot).alias("hot")), "anchors")
    lists = (single.join(anchors, "h").groupBy("doc_id", "t1").agg(F.collect_list(F.struct("h", "s", "k", "hot")).alias("segs")))
    members = written(_texts(rows, lists, window), "members")

    found = members.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("h").alias("h"),
                                            F.first("words").alias("words"), F.max("k").alias("k"))
    found = written(found.where("k > 1 or least < most or h != c1"), "segments")
    size = found.agg(F.coalesce(F.sum(F.col("k") + window - 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(size) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    answers = found.select(shard.alias("shard"), "c1", "c2", "least", "words").groupBy("shard").applyInPandas(
        lambda pdf: _searched(window)(pdf), "c1 long, c2 long, owners array<long>")
    answers = written(answers, "answers")
    hits = (members.select("doc_id", "t1", "s", "c1", "c2").join(answers, ["c1", "c2"])
            .select("doc_id", "t1", "s", F.transform("owners", lambda o: o < F.col("doc_id")).alias("hit"))
            .where(F.exists("hit", lambda x: x)))
    hits = hits.groupBy("doc_id", "t1").agg(F.collect_list(F.struct("s", "hit")).alias("hits"))
    flags = (long.where("copy").select("doc_id", "t1", F.lit(None).cast("array<struct<s:int,hit:array<boolean>>>").alias("hits"))
             .union(hits).groupBy("doc_id").agg(F.collect_list(F.struct("t1", "hits")).alias("flags")))
    return rows.join(written(flags, "flags"), "doc_id", "left")


def covered(n: int, hits: list[dict] | None, window: int) -> np.ndarray:
    """The words that flagged windows cover; ``hits`` None: all."""
    out = np.zeros(n + 1, dtype=np.int64)
    if hits is None:
        return np.ones(n, dtype=bool)
    for h in hits:
        at = h["s"] + np.flatnonzero(h["hit"])
        np.add.at(out, at, 1)
        np.add.at(out, at + window, -1)
    return np.cumsum(out)[:n] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by
    one blank, as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, flag in zip(batch.column(1), flags):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words), dtype=bool)
                if flag:
                    hashes = np.concatenate([w.hashes for w in words_of(pa.array([text.as_py()], pa.large_binary()))])
                    for f in flag:
                        if f["t1"] == signature(hashes)[0]:
                            gone |= covered(len(words), f["hits"], window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if flag else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    rows = repeated_words(docs, id_col, text_col, window, hot).select("doc_id", "text", "flags")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
