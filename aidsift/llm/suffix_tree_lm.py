"""Language-model scores by a probabilistic suffix tree (operator 3).

Symbols are bytes. A text is its words (A-Z lower-cased), each spelled and
closed by a blank, and then the end, a newline; so the probability of the
bytes is that of the words. The tree holds contexts of up to ``DEPTH`` bytes.

1. Rows are dealt into chunks of about ``CHUNK`` bytes. A chunk gives each distinct word, and each distinct run of
   ``DEPTH`` bytes and the next one, that it has, with how often its training rows hold it.
2. A context is looked at if it occurs ``LEAST`` times in training, however large that is, and
   retained if its next bytes diverge from its suffix's: n * KL over ``DIVERGENCE`` nats.
   Suffixes of retained contexts stay, and all contexts of up to ``SHORT`` bytes, whose number the alphabet bounds.
3. Next-symbol distributions are smoothed towards the suffix's by Witten-Bell
   weights, and the root's by one count for each byte, so all are proper.
4. The runs go to shards by the last ``SHORT`` + 1 bytes of the context, sorted and compressed: a row for each chunk and shard. All longer contexts that end
   so are in one shard, which grows its part of the tree and scores its runs; neither the driver nor a task holds more of it.
   Words go to shards by their hashes, which sum their counts.
5. The scores and counts go back to the chunks, in the order in which the keys came; a chunk's texts give the same keys again. Of the
   runs of one state and last byte, one score is sent. A byte is scored in the state of its longest retained suffix.
   A token's probability is that of its bytes mixed with the word unigram's,
   (1 - ``unigram``) to ``unigram``, which knows whole words better than spelling does. The unigram
   gives a word c / (N + V), c of N training tokens of V kinds, and spreads the rest, V / (N + V), over
   all words by their spelling: the probabilities of all texts sum to 1 at most, unseen words and all.

The unigram score beside it counts words exactly. A chunk asks for each of its words once, so no key is frequent.

A null or empty text has the end token only. Without training texts all
counts are zero and bytes are equally likely. A null id trains. Repeated rows
are scored each on its own, and count in training as often as they come.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .wordhash import flat, mix, words as words_of

DEPTH = 7
LEAST = 20
SHORT = 2
CHUNK = 28 << 20
#: Bytes of text for each shard; their runs are about a quarter as many.
SHARD = 4 << 20
DIVERGENCE = 6.0
UNIGRAM = 0.5
#: Keys of a chunk that wait for being merged with the others.
HELD = 1 << 21
#: Of compression, for the texts of a chunk.
LEVEL = 5
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[0] = 1  # a NUL is spelled so, as 0 stands for what lies before a row


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the rows one after the other, each with a newline before it
    (not scored) and one at its end; where each row begins; where each token does."""
    rows, size = len(off) - 1, ends - starts + 1
    word_row = np.repeat(np.arange(rows), np.diff(off))
    before = np.cumsum(size) - size
    place = before + 2 * word_row + 1  # of each word's first byte
    total = int(size.sum()) + 2 * rows
    out = np.full(total, 32, dtype=np.uint8)
    if len(starts):
        inner = size - 1
        at = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
        out[np.repeat(place, inner) + at] = _LOW[data[np.repeat(starts, inner) + at]]
    lengths = np.bincount(word_row, size, rows).astype(np.int64) + 2
    begin = np.append(0, np.cumsum(lengths))
    out[begin[:-1]] = 10
    out[begin[1:] - 1] = 10
    return out, begin, np.sort(np.concatenate([place, begin[1:] - 1]))


def scored_bytes(begin: np.ndarray) -> np.ndarray:
    """Of each byte, whether it is scored: all but the first of a row."""
    out = np.ones(begin[-1], dtype=bool)
    out[begin[:-1]] = False
    return out


def turned_grams(b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each scored byte: itself, the byte before it, and so on for ``DEPTH`` bytes (0 beyond the row), packed from the highest byte down."""
    around = np.concatenate([np.zeros(DEPTH, dtype=np.uint8), b])
    out = np.ndarray(len(b), dtype="<u8", buffer=around, strides=(1,)).astype(np.uint64)
    for k in range(1, DEPTH):  # places with k bytes of their row before them
        at = begin[:-1] + k
        at = at[at < begin[1:]]
        out[at] &= np.uint64(~((1 << (8 * (DEPTH - k))) - 1) & ((1 << 64) - 1))
    return out[scored_bytes(begin)]


def grams(b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``turned_grams`` with their bytes turned round: the last byte lowest."""
    return turned_grams(b, begin).byteswap()


@dataclass
class Tree:
    kind: np.ndarray  # a column for each byte; bytes that training lacks share column 0
    child: np.ndarray  # [state, kind of the byte before]
    logs: np.ndarray  # [state, kind of the next byte], log10

    def scores(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of the last byte of each packed run after the others, and how many of these its state has."""
        depth = np.zeros(len(packed), dtype=np.uint8)
        state, live = np.zeros(len(packed), dtype=np.int32), np.arange(len(packed))
        for k in range(1, DEPTH + 1):
            before = self.kind[(packed[live] >> np.uint64(8 * k)) & np.uint64(255)]
            deeper = self.child[state[live], before]  # bytes that training lacks, and 0, lead nowhere
            live, deeper = live[deeper > 0], deeper[deeper > 0]
            state[live], depth[live] = deeper, k
        return self.logs[state, self.kind[packed & np.uint64(255)]], depth


def grow(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], divergence: float, short: int = 0) -> Tree:
    """A tree of counts: ``levels[k]`` has (context, next byte, count) of the frequent
    contexts of k bytes. Contexts of up to ``short`` bytes are all retained."""
    _, after, n = levels[0]
    kind = np.zeros(256, dtype=np.int16)
    kind[np.sort(after)] = np.arange(1, len(after) + 1)
    width, missing = len(after) + 1, 256 - len(after)
    root = np.zeros(width)
    root[kind[after]] = n
    contexts, smooth, parents, keep = [np.zeros(1, dtype=np.int64)], [((root + 1) / (n.sum() + 256))[None, :]], [None], [np.ones(1, dtype=bool)]
    for k in range(1, len(levels)):
        c, after, n = levels[k]
        unique, at = np.unique(c, return_inverse=True)
        up = np.searchsorted(contexts[-1], unique & ((1 << (8 * (k - 1))) - 1))  # a suffix is as frequent, so it is there
        total, kinds, base = np.bincount(at, n, len(unique)), np.bincount(at, minlength=len(unique)), smooth[-1][up]
        gain = np.bincount(at, n * np.log(n / total[at] / base[at, kind[after]]), len(unique))
        base *= kinds[:, None]  # in place, as these tables are the largest part of a shard's memory
        base[at, kind[after]] += n
        base /= (total + kinds)[:, None]
        contexts.append(unique)
        smooth.append(base)
        parents.append(up)
        keep.append((gain >= divergence) | (k <= short))
    for k in range(len(levels) - 1, 1, -1):
        keep[k - 1][parents[k][keep[k]]] = True
    states = np.concatenate([[0], np.cumsum([x.sum() for x in keep])])
    child, logs = np.zeros((states[-1], width), dtype=np.int32), np.empty((states[-1], width), dtype=np.float32)
    for k, kept in enumerate(keep):
        logs[states[k]:states[k + 1]] = np.log10(smooth[k][kept])
        if k:
            number = states[k - 1] + np.cumsum(keep[k - 1]) - 1
            child[number[parents[k][kept]], kind[contexts[k][kept] >> (8 * (k - 1))]] = np.arange(states[k], states[k + 1])
    return Tree(kind, child, logs)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of ``parts`` (keys, counts) with the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def level(packed: np.ndarray, n: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, next byte, count) of the contexts of ``k`` bytes that occur ``least`` times in packed runs."""
    has = (n > 0) & (packed >= np.uint64(1 << (8 * k)) if k else True)
    key, n = _merged([(packed[has] & np.uint64((1 << (8 * k + 8)) - 1), n[has])])
    c = (key >> np.uint64(8)).astype(np.int64)
    _, at = np.unique(c, return_inverse=True)
    often = np.bincount(at, n)[at] >= least if len(c) else np.zeros(0, dtype=bool)
    return c[often], (key & np.uint64(255)).astype(np.int64)[often], n[often]


def _coded(values: np.ndarray) -> bytes:
    """``values`` compressed, with all bytes of one significance together."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), codec="zstd", asbytes=True)


def _decoded(data: pa.Buffer, n: int, dtype: type) -> np.ndarray:
    """The ``n`` values that ``_coded`` made ``data`` of."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def _dealt(keys: np.ndarray, n_shards: int, kind: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its words (kind 0) or runs (1, their bytes turned round) in ``keys``, which ascend."""
    if kind == 1:  # few ends of runs, which are neighbours
        end, many = _distinct(keys >> np.uint64(8 * (DEPTH - SHORT - 1)))
        keys = mix(end & np.uint64((1 << (8 * SHORT + 8)) - 1))
    shard = ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int32)  # words of a shard are near each other
    shard = np.repeat(shard, many) if kind == 1 else shard
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


def _firsts(turned: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each depth: the places of the runs whose state is so deep, and which of them are the first with their state and last byte.
    Runs of one state and last byte ascend one after the other, but for runs of deeper states."""
    for k in range(DEPTH + 1):
        at = np.flatnonzero(depth == k)
        state = turned[at] >> np.uint64(8 * (DEPTH - k))
        yield at, np.append(True, state[1:] != state[:-1])[:len(at)]


def _scores_coded(turned: np.ndarray, each: np.ndarray, depth: np.ndarray) -> tuple[bytes, bytes]:
    """The scores of ascending runs, one for each state and last byte, and the depths of the states."""
    return _coded(np.concatenate([each[at][first] for at, first in _firsts(turned, depth)])), _coded(depth)


def _scores_decoded(turned: np.ndarray, data: pa.Buffer, depths: pa.Buffer) -> np.ndarray:
    depth, out, done = _decoded(depths, len(turned), np.uint8), np.empty(len(turned), dtype=np.float32), 0
    parts = list(_firsts(turned, depth))
    values = _decoded(data, sum(int(first.sum()) for _, first in parts), np.float32)
    for at, first in parts:
        out[at] = values[done - 1 + np.cumsum(first)]
        done += int(first.sum())
    return out


def _distinct(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array and how often each occurs."""
    first = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])[:len(ascending)])
    return ascending[first], np.diff(np.append(first, len(ascending)))


def _sorted_distinct(*parts: np.ndarray) -> np.ndarray:
    keys = np.concatenate(parts)
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])[:len(keys)]]


FOUND = "kind int, chunk long, shard long, key long, n long, data binary, counts binary, texts binary"


def _counted(rows: DataFrame, n_shards: int) -> DataFrame:
    """In one pass over the texts, by ``kind``: 0 the distinct words and 1 the distinct runs of bytes of a ``chunk`` that belong
    to a ``shard`` (``n`` of them; ``data``: the steps between them, runs with their bytes turned round, so that those of
    one end are neighbours; ``counts``: of each, in training texts, which may be 0); 2 the training texts of some
    rows (``n``); 3 the last ``SHORT`` + 1 bytes of a chunk's runs with their counts; 4 some rows of a chunk as a compressed Arrow stream (``texts``)."""
    fields = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("shard", pa.int64()), ("key", pa.int64()), ("n", pa.int64()),
                        ("data", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])

    def table(kind: int, size: int, **columns) -> pa.RecordBatch:
        columns["kind"] = pa.array(np.full(size, kind, dtype=np.int32))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in fields], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        new: dict[tuple[int, bool], list] = defaultdict(list)  # words and runs, of training texts or others, as they come
        parts: dict[tuple[int, int], list] = defaultdict(list)  # by kind and shard: ascending keys and their counts
        ends: list = []

        def sort_in() -> None:
            for kind in (0, 1):
                train, other = (np.concatenate([np.zeros(0, dtype=np.uint64), *new.pop((kind, of), [])]) for of in (True, False))
                train.sort()
                rest = _sorted_distinct(other)
                keys, n = _merged([_distinct(train), (rest, np.zeros(len(rest), dtype=np.int64))])
                if kind:
                    end, at = np.unique(keys >> np.uint64(8 * (DEPTH - SHORT)), return_index=True)
                    ends.append((end, np.add.reduceat(n, at) if len(at) else n))
                for shard, part in _dealt(keys, n_shards, kind):
                    parts[kind, shard].append((keys[part], n[part].astype(np.uint32)))

        def closed() -> Iterator[pa.RecordBatch]:
            sort_in()
            end, n = _merged(ends)
            ends.clear()
            yield table(3, len(end), key=pa.array((end << np.uint64(8 * (DEPTH - SHORT))).byteswap().view(np.int64)), n=pa.array(n))
            while parts:
                (kind, shard), found = parts.popitem()
                keys, n = _merged(found) if len(found) > 1 else found[0]
                yield table(kind, 1, chunk=pa.array([chunk]), shard=pa.array([shard]), n=pa.array([len(keys)]),
                            data=pa.array([_coded(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), counts=pa.array([_coded(n.astype(np.uint32))], pa.binary()))

        for batch in batches:
            trains, text = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2)
            data, _ = flat(text)
            yield table(2, 1, n=pa.array([int(trains.sum())]))
            for w in words_of(text, lower=True):
                b, begin, _ = spelled(data, w.starts, w.ends, w.off)
                turned = turned_grams(b, begin)
                if size and size + len(turned) > CHUNK:
                    yield from closed()
                    chunk, size = chunk + 1, 0
                size += len(turned)
                of = trains[w.first:w.first + w.rows]
                for kind, keys, many in ((0, w.hashes, np.diff(w.off)), (1, turned, np.diff(begin) - 1)):
                    mine = np.repeat(of, many)
                    new[kind, True].append(keys[mine])
                    new[kind, False].append(keys[~mine])
                if sum(map(len, new[1, True])) + sum(map(len, new[1, False])) > HELD:
                    sort_in()
                sink, part = pa.BufferOutputStream(), batch.slice(w.first, w.rows)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                    out.write_batch(part)
                yield table(4, 1, chunk=pa.array([chunk]), texts=pa.array([sink.getvalue().to_pybytes()], pa.binary()))
        if size:
            yield from closed()

    return rows.mapInArrow(run, FOUND)


def _keys(table: pa.Table) -> Iterator[np.ndarray]:
    """The ascending keys of each of a shard's rows."""
    for n, data in zip(table["n"].to_pylist(), table["data"]):
        yield np.cumsum(_decoded(data.as_buffer(), n, np.uint64))


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct keys of a shard's rows and their counts."""
    key, new = np.zeros(0, dtype=np.uint64), []
    for keys in _keys(table):
        new.append(keys)
        if sum(map(len, new)) > HELD:
            key, new = _sorted_distinct(key, *new), []
    key = _sorted_distinct(key, *new)
    n = np.zeros(len(key), dtype=np.int64)
    for keys, counts in zip(_keys(table), table["counts"]):
        n[np.searchsorted(key, keys)] += _decoded(counts.as_buffer(), len(keys), np.uint32)
    return key, n


def _word_counts(found: DataFrame) -> DataFrame:
    """``chunk``, ``shard``, ``n``, ``data``: the counts in training of the words of a chunk and shard, coded, in their order. Each shard's
    first row has its ``tokens`` and ``kinds`` in training."""

    def run(table: pa.Table) -> pa.Table:
        key, n = _summed(table)
        data = [_coded(n[np.searchsorted(key, keys)]) for keys in _keys(table)]
        sums = [pa.array([int(x)] + [0] * (len(data) - 1), pa.int64()) for x in (n.sum(), (n > 0).sum())]
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "n": table["n"], "data": pa.array(data, pa.binary()),
                         "tokens": sums[0], "kinds": sums[1]})

    return (found.where("kind = 0").select("chunk", "shard", "n", "data", "counts")
            .groupBy("shard").applyInArrow(run, "chunk long, shard long, n long, data binary, tokens long, kinds long"))


def _run_scores(found: DataFrame, least: int, divergence: float) -> DataFrame:
    """``chunk``, ``shard``, ``n``, ``data``: the log10 probability of the last byte of each run of a chunk and shard, coded, in their order."""
    short = found.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toArrow()  # as many as the alphabet has runs of SHORT + 1
    key, n = short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy()
    shared = found.sparkSession.sparkContext.broadcast([level(key, n, k, least if k else 0) for k in range(SHORT + 1)])

    def run(table: pa.Table) -> pa.Table:
        turned, n = _summed(table)
        packed = turned.byteswap()
        tree = grow([*shared.value, *(level(packed, n, k, least) for k in range(SHORT + 1, DEPTH + 1))], divergence, SHORT)
        each, depth = tree.scores(packed)
        out = [_scores_coded(keys, each[at], depth[at]) for keys in _keys(table) for at in [np.searchsorted(turned, keys)]]
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "n": table["n"], "data": pa.array([x for x, _ in out], pa.binary()),
                         "depths": pa.array([x for _, x in out], pa.binary())})

    return (found.where("kind = 1").select("chunk", "shard", "n", "data", "counts")
            .groupBy("shard").applyInArrow(run, "chunk long, shard long, n long, data binary, depths binary"))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
          divergence: float = DIVERGENCE, unigram: float = UNIGRAM) -> DataFrame:
    """Per row: ``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_shards = size // SHARD + 1
    found = written(_counted(rows, n_shards), "runs")
    counts = written(_word_counts(found), "counts")
    ends = found.where("kind = 2").agg(F.sum("n").alias("n")).first()["n"] or 0
    totals = counts.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    n_all = ends + (totals["n"] or 0)
    n_kinds = (ends > 0) + (totals["v"] or 0)
    spelling_of = _run_scores(found, least, divergence)
    room = float(n_all + n_kinds + 1)
    # of a token seen c times and spelled with probability p: by_spelling * p + by_count * c
    by_count = unigram / max(n_all + n_kinds, 1)
    by_spelling = 1 - unigram * n_all / max(n_all + n_kinds, 1)
    log_spelling = float(np.log10(by_spelling)) if by_spelling > 0 else -np.inf

    def mixture(spelling: np.ndarray, count: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):  # a long word's probability may be too small for a double
            return np.where(count > 0, np.log10(by_spelling * 10 ** spelling + by_count * count), log_spelling + spelling)

    end_log, room_log = float(np.log10(ends + 1.0)), float(np.log10(room))
    result = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def batches(texts: pa.Table) -> Iterator[pa.RecordBatch]:
        for rows in texts["texts"]:
            yield from pa.ipc.open_stream(rows.as_buffer())

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        turned, known, out = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), []
        new: tuple[list, list] = ([], [])
        for batch in batches(texts):
            data, _ = flat(batch.column(2))
            for w in words_of(batch.column(2), lower=True):
                new[0].append(_sorted_distinct(w.hashes))
                new[1].append(_sorted_distinct(turned_grams(*spelled(data, w.starts, w.ends, w.off)[:2])))
            if sum(map(len, new[1])) > HELD:
                known, turned, new = _sorted_distinct(known, *new[0]), _sorted_distinct(turned, *new[1]), ([], [])
        known, turned, new = _sorted_distinct(known, *new[0]), _sorted_distinct(turned, *new[1]), ([], [])
        logs, seen = np.empty(len(turned), dtype=np.float32), np.empty(len(known), dtype=np.int64)
        place = {(k, shard): part for k, keys in enumerate((known, turned)) for shard, part in _dealt(keys, n_shards, k)}
        for kind, shard, n, data, depths in zip(*(answers[c] for c in ("kind", "shard", "n", "data", "depths"))):
            at = place[kind.as_py(), shard.as_py()]
            if kind.as_py():
                logs[at] = _scores_decoded(turned[at], data.as_buffer(), depths.as_buffer())
            else:
                seen[at] = _decoded(data.as_buffer(), n.as_py(), np.int64)
        del place
        for batch in batches(texts):
            data, _ = flat(batch.column(2))
            for w in words_of(batch.column(2), lower=True):
                b, begin, tokens = spelled(data, w.starts, w.ends, w.off)
                own, at = np.unique(turned_grams(b, begin), return_inverse=True)
                each = np.zeros(len(b), dtype=np.float64)
                each[scored_bytes(begin)] = logs[np.searchsorted(turned, own)][at]
                spelling = np.add.reduceat(each, tokens) if len(tokens) else np.zeros(0)
                row, is_end = w.row_of(), np.zeros(len(tokens), dtype=bool)
                is_end[w.off[1:] + np.arange(w.rows)] = True
                own, at = np.unique(w.hashes, return_inverse=True)
                count = seen[np.searchsorted(known, own)][at]
                n_tokens = np.diff(w.off).astype(np.int64) + 1
                score = np.bincount(row, mixture(spelling[~is_end], count), w.rows) + mixture(spelling[is_end], np.full(w.rows, ends))
                base = np.bincount(row, np.log10(count + 1.0), w.rows) + end_log - n_tokens * room_log
                hits = np.bincount(row, count > 0, w.rows).astype(np.int64) + (ends > 0)
                out.append(pa.RecordBatch.from_arrays(
                    [*batch.slice(w.first, w.rows).columns[:2], pa.array(n_tokens), pa.array(hits), pa.array(base), pa.array(score)], schema=result))
        return pa.Table.from_batches(out, result)

    texts = found.where("kind = 4").select("chunk", "texts")
    answers = counts.select("chunk", F.lit(0).alias("kind"), "shard", "n", "data", F.lit(None).cast("binary").alias("depths")).union(
        spelling_of.select("chunk", F.lit(1), "shard", "n", "data", "depths"))
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
