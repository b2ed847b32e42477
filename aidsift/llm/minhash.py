"""Near-duplicate documents by bottom-k sketches of one hash function (operator 10).

A document's set holds its distinct shingles of ``words`` words, lower-cased
in A-Z; with fewer words the whole sequence is one shingle; without words it
is empty and linked with nothing. Documents are linked if the Jaccard
similarity of their sets is at least ``percent`` / 100.

1. Equal sets are one node from here on (its smallest id).
2. A sketch holds the ``WIDE`` smallest shingle hashes (32 bits of each); the
   smallest ``SKETCH`` of them are indexed whole. Of 24 values of the union's
   sketch two linked sets share a binomial number with mean 18, and under
   ``NEED`` = 7 with a probability below 4e-7; of 128 values under
   ``WIDE_NEED`` = 70 with a probability below 1e-6.
3. Inverted lists of the indexed values give the overlaps. Lists of at most
   ``SHORT`` nodes give pairs of ids, counted per pair. A pair that shares
   only values of longer lists is one of two nodes that hold ``NEED`` of them.
4. Those nodes are indexed anew: of the values of its whole sketch a node
   lists the rarest, one more than it may miss of the union's. Passages that
   many documents share are then left out, unless they are most of the text.
   Short lists again give pairs. In long ones the nodes are compared by their
   sketches: first with the smallest ids of a node's ``HEADS`` longest lists; then each node outside
   the component of a list's smallest id, in blocks, with all nodes of the list. Each round proposes the
   best few untested partners per node, of as many components as it can. Lists whose nodes have further
   ones are looked at again until none has, so nothing is capped and a large group of near copies costs a
   link for each copy.
5. The union-sketch estimate filters, the exact similarity of the full sets
   confirms, and star contraction gives the components. Of sets that sketches hold whole the filter is
   exact, but for values that 32 bits take for one, so few pairs are tested in vain.

Rows with a null id are not linked and kept; rows that repeat an id count as
one document; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import written
from .worker import release
from .wordhash import mix, words as words_of

SHINGLE_WORDS = 5
PERCENT = 75
SKETCH = 24
NEED = 7
SHORT = 48
#: Values, 32 bits of each, by which nodes of long lists are compared; all of a set unless it is larger.
FULL = 1024
#: Nodes of a long list that are compared as one block.
BLOCK = 512
#: Shared values of a block's sketches that are multiplied at a time.
COLUMNS = 2048
#: Rows of a block whose estimates are made at a time.
ROWS = 64
#: Untested partners a node of a block may propose in a round.
BEST = 8
#: Of so many of its lists, the longest, a node is compared with the smallest id first; of the others in blocks.
HEADS = 4
#: Ids whose texts are picked by a broadcast (16 bytes each or so); more are joined by a shuffle of the texts.
PICKED = 4_000_000
WIDE = 128
WIDE_NEED = 70


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes (uint64) of each text."""
    for w in words_of(texts, lower=True):
        grams, _ = w.grams(k)
        for lo, hi in zip(w.off[:-1], w.off[1:]):
            if hi - lo >= k:
                grams[lo:hi - k + 1].sort()  # np.unique hashes first, which takes longer
                s = grams[lo:hi - k + 1]
                yield s[np.append(True, s[1:] != s[:-1])]
            elif hi > lo:
                yield mix(np.array([np.uint64(hi - lo)]) + np.add.reduce(w.hashes[lo:hi] * np.arange(1, 2 * (hi - lo), 2, dtype=np.uint64)))
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``s1``, ``s2`` (a 128-bit hash of the set), ``sk`` (what is
    indexed of its sketch), ``wide`` (the sketch, upper 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, s1, s2, sk, wide = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                s1.append(int(np.add.reduce(mix(s ^ np.uint64(1 << 40))).view(np.int64)) if len(s) else 0)
                s2.append(int(np.add.reduce(mix(s ^ np.uint64(1 << 41))).view(np.int64)) if len(s) else 0)
                sk.append(s[:SKETCH].view(np.int64))
                wide.append(np.unique(s[:WIDE] >> np.uint64(32)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(sk, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "sk", "wide"])

    return _input(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, sk array<long>, wide array<long>")


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``n``, ``s`` and ``f`` of the documents in ``ids`` (a written table): the size of the set,
    the whole set and its ``FULL`` smallest values, 32 bits of each (binary, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            short = [np.unique(s[:FULL] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array(short, pa.binary())], names=["doc_id", "n", "s", "f"])

    few = ids.count() <= PICKED
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, s binary, f binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
              .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _need(n: str, m: str):
    """Indexed values that two linked sets of these sizes share."""
    return F.least(F.lit(NEED), F.ceil((F.col(n) + F.col(m)) * 3 / 7))


def _passes(x: list[np.ndarray], y: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The union-sketch estimate for all x against all y (ascending sketches of
    sets of sizes n and m), 0 where linked sets are as good as excluded."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    if not len(shared):
        return np.zeros((len(x), len(y)))

    def flat(z: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(z)
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        return np.repeat(np.arange(len(z)), [len(v) for v in z])[hit], at[hit]

    def table(rows: int, held: tuple[np.ndarray, np.ndarray], lo: int) -> np.ndarray:
        part = (held[1] >= lo) & (held[1] < lo + COLUMNS)
        out = np.zeros((rows, min(COLUMNS, len(shared) - lo)), dtype=np.float32)
        out[held[0][part], held[1][part] - lo] = 1
        return out

    # shared values a few thousand at a time, estimates a few rows at a time: memory grows with neither
    held_x, held_y = flat(x), flat(y)
    overlap = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, len(shared), COLUMNS):
        overlap += table(len(x), held_x, lo) @ table(len(y), held_y, lo).T
    size_x, size_y = (np.array([len(s) for s in z]) for z in (x, y))
    # both sketches hold all values of their sets up to the smaller of their last ones
    last_x, last_y = ([s[-1] if size > FULL else np.iinfo(np.int64).max for s, size in zip(z, k)] for z, k in ((x, n), (y, m)))
    m = m.astype(float)
    for lo in range(0, len(x), ROWS):
        part = slice(lo, lo + ROWS)
        k, both = n[part, None].astype(float), overlap[part].astype(float)
        in_x = np.stack([np.searchsorted(s, last_y, side="right") for s in x[part]])
        in_y = np.stack([np.searchsorted(s, last_x[part], side="right") for s in y]).T
        union = np.maximum(in_x + in_y - both, 1)
        est = both / union
        whole = np.maximum((k + m) / (1 + est), union)
        # 32 bits may take two of a set's values for one, hardly ever more than two such pairs
        slack = 2 / union + 5 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / union * (1 - union / whole))
        good = (est >= PERCENT / 100 - slack) & (4 * np.minimum(k, m) >= 3 * np.maximum(k, m))
        # sets that both sketches hold whole: of the values they share, 32 bits hide as many at most as the smaller loss
        most = both + np.minimum(k - size_x[part, None], m - size_y)
        good &= (k > FULL) | (m > FULL) | (100 * most >= PERCENT * (k + m - most))
        overlap[part] = np.where(good, est, 0.0)
    return overlap


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (a, b) whose sketches pass the estimate."""
    for pdf in batches:
        keep = [bool(_passes([np.frombuffer(x, np.uint32)], [np.frombuffer(y, np.uint32)], np.array([n]), np.array([m]))[0, 0] > 0)
                for x, y, n, m in zip(pdf.f_a, pdf.f_b, pdf.n_a, pdf.n_b)]
        yield pdf[["a", "b"]][keep]


def _proposals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block of a long list: for each node of the block (role 0) the best
    partners among the nodes of the slice (role 1) in other components, the best one of each component
    first. ``more``: the node has further ones in this list ``v``."""
    x, y = pdf[pdf.role == 0], pdf[pdf.role == 1]
    out: list[tuple[int, int, int, bool]] = []
    if len(x) and len(y):
        est = _passes(*([np.frombuffer(f, np.uint32) for f in z.f] for z in (x, y)), x.n.to_numpy(), y.n.to_numpy())
        names, comps = y.rep.to_numpy(), y.comp.to_numpy()
        for i in np.flatnonzero(est.any(axis=1)):
            est[i, comps == x.comp.iloc[i]] = 0
            if x.tested.iloc[i] is not None:
                est[i, np.isin(names, x.tested.iloc[i])] = 0
            a, open_ = int(x.rep.iloc[i]), np.flatnonzero(est[i])
            open_ = open_[np.argsort(-est[i, open_], kind="stable")]
            later = np.ones(len(open_), dtype=bool)
            later[np.unique(comps[open_], return_index=True)[1]] = False
            for j in open_[np.argsort(later, kind="stable")][:BEST]:
                out.append((int(x.v.iloc[0]), min(a, int(names[j])), max(a, int(names[j])), len(open_) > BEST))
    return pd.DataFrame(out, columns=["v", "a", "b", "more"]).astype({"v": "int64", "a": "int64", "b": "int64", "more": "bool"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links), ``kept``, per row."""
    table = written(sketched(docs, id_col, text_col, words), "sketches")
    full = table.where("n > 0 and doc_id is not null")
    nodes = written(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sk").alias("sk"),
                                                   F.first("wide").alias("wide")), "sets")

    # inverted lists, without those of a single node
    entries = nodes.select("rep", "n", F.explode("sk").alias("v"))
    counts = written(entries.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    entries = written(entries.join(counts, "v"), "entries")
    in_long = entries.where(f"m > {SHORT}").groupBy("rep", "n").agg(F.count("*").alias("hot"))
    short = entries.where(f"m <= {SHORT}").join(in_long.select("rep", "hot"), "rep", "left").fillna(0, ["hot"])
    x, y = (short.select("v", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "hot")]) for s in "ab")
    pairs = (x.join(y, "v").where("rep_a < rep_b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
             .groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b", "hot_a", "hot_b")
             .agg(F.count("*").alias("overlap"))
             .where(F.col("overlap") + F.least("hot_a", "hot_b") >= _need("n_a", "n_b")).select("a", "b").distinct())
    pairs = written(pairs, "pairs")

    # nodes that may share long lists only; two linked sets share 3/4 of the larger one at least, and so of either
    many = in_long.where(F.col("hot") >= F.least(F.lit(NEED), F.ceil(F.col("n") * 3 / 4))).select("rep")
    source, many = _input(docs, id_col, text_col), written(many, "many")
    whole = written(_set_table(source, many.toDF("doc_id"), words), "whole")
    wide = nodes.join(many, "rep", "left_semi").select("rep", "n", "wide")
    sized = whole.select(F.col("doc_id").alias("rep"), "n", "f")
    values = wide.select("rep", "n", F.size("wide").alias("size"), F.explode("wide").alias("v"))
    often = written(values.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "often")
    rank = F.row_number().over(Window.partitionBy("rep", "n").orderBy("m", "v"))  # of the at most WIDE values of a node
    # values of one node alone are its rarest and need no row: the others' ranks begin after them
    alone = F.col("size") - F.count("*").over(Window.partitionBy("rep", "n"))
    values = values.join(often, "v").withColumn("rank", rank + alone)
    values = values.where(F.col("rank") <= F.col("size") + 1 - F.least(F.lit(WIDE_NEED), F.ceil(F.col("n") * 3 / 4)))
    values = written(values.select("v", "rep", "n", "m"), "rare")
    rare = values.where(f"m <= {SHORT}").select("v", "rep", "n")
    near = (rare.toDF("v", "a", "n_a").join(rare.toDF("v", "b", "n_b"), "v")
            .where("a < b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").select("a", "b").distinct())
    hot = values.where(f"m > {SHORT}").select("v", "rep", "n", "m")
    heads = written(hot.groupBy("v").agg(F.min("rep").alias("head")), "heads")
    # a row per node, so that its component is looked up once and not for each of its lists
    held = written(hot.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("m", "v")), asc=False)["v"].alias("vs")), "held")
    stars = (held.select("rep", F.explode(F.slice("vs", 1, HEADS)).alias("v")).join(heads, "v").where("rep > head")
             .select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())

    def promising(frame: DataFrame) -> DataFrame:
        for side in "ab":
            frame = frame.join(sized.select(*[F.col(c).alias(x) for c, x in (("rep", side), ("n", f"n_{side}"), ("f", f"f_{side}"))]), side)
        return frame.select("a", "b", "n_a", "n_b", "f_a", "f_b").mapInPandas(_promising, "a long, b long")

    stars = promising(stars)
    pairs = written(pairs.union(promising(near)).distinct(), "pairs")

    first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars).distinct(), "first")
    ids = written(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id").join(many.toDF("doc_id"), "doc_id", "left_anti"), "ids")
    sets = whole.union(written(_set_table(source, ids, words), "whole")).select("doc_id", "s")
    links = written(_linked(first, sets, percent), "links")
    tested, comp = first, written(components(links), "components")

    def of(frame: DataFrame, col: str) -> DataFrame:
        return frame.join(comp.select(F.col("id").alias(col), F.col("component_id").alias("c")), col, "left") \
            .withColumn(f"{col}_comp", F.coalesce("c", col)).drop("c")

    later = of(of(pairs.join(tested, ["a", "b"], "left_anti"), "a"), "b").where("a_comp != b_comp").select("a", "b")
    open_lists, more = heads.select("v"), not heads.isEmpty()
    while True:
        if more:
            hot = of(held, "rep").select("rep", "n", "rep_comp", F.explode("vs").alias("v")).join(open_lists, "v", "left_semi")
            found = written(_blocks(hot, tested, sized), "proposed")
            later = later.union(found.select("a", "b"))
            open_lists = written(found.where("more").select("v").distinct(), "open")
            more = not open_lists.isEmpty()
        later = written(later.distinct().join(tested, ["a", "b"], "left_anti"), "later")
        found = written(_linked(later, sets, percent), "links")
        if not found.isEmpty():
            stars = comp.select(F.col("component_id").alias("a"), F.col("id").alias("b"))
            comp = written(components(stars.union(found)), "components")
        if not more:  # each node has proposed all that it may be linked with in other components
            break
        tested = written(tested.union(later), "tested")
        later = later.limit(0)

    named = (full.join(nodes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
             .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
             .groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id")))
    named = written(named, "named")
    return (table.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _blocks(hot: DataFrame, tested: DataFrame, sized: DataFrame) -> DataFrame:
    """Proposed pairs (a, b) of the long lists: each node outside the component
    of its list's head against all nodes of the list. Sketches join the
    rows of lists with such nodes alone."""
    comps = hot.groupBy("v", "rep_comp").agg(F.min("rep").alias("head"), F.count("*").alias("held"))
    lists = comps.groupBy("v").agg(F.min(F.struct("head", "rep_comp", "held")).alias("top"), F.sum("held").alias("m"))
    lists = lists.select("v", F.col("top.rep_comp").alias("head_comp"), "m", (F.col("m") - F.col("top.held")).alias("apart"))
    lists = written(lists.where("apart > 0"), "lists")  # the others hold one component
    rows = written(hot.join(lists, "v"), "blocks")
    done = tested.select(F.col("a").alias("rep"), F.col("b").alias("o")).union(tested.select("b", "a"))
    left = rows.where("rep_comp != head_comp").select("rep")
    done = done.join(left, "rep", "left_semi").groupBy("rep").agg(F.collect_set("o").alias("tested"))
    n_blocks, n_slices = F.ceil(F.col("apart") / BLOCK), F.ceil(F.col("m") / (4 * BLOCK))
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    block = rows.where("rep_comp != head_comp").join(done, "rep", "left").select(
        "v", (spread % n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice"), "rep", "n",
        F.col("rep_comp").alias("comp"), "tested", F.lit(0).alias("role"))
    others = rows.select(
        "v", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), (spread % n_slices).alias("slice"), "rep", "n",
        F.col("rep_comp").alias("comp"), F.lit(None).cast("array<long>").alias("tested"), F.lit(1).alias("role"))
    return (block.union(others.select(*block.columns)).join(sized.select("rep", "f"), "rep").groupBy("v", "block", "slice")
            .applyInPandas(_proposals, "v long, a long, b long, more boolean").distinct())
