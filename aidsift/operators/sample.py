"""Seeded sampling, splits, dedupe and ordering (WN1-WN9, ST1-ST6).

Randomness is a pure function of the row: ``md5("<seed>:<id>")``. The same
seed gives the same split on any cluster size and in DuckDB.

No operator here uses an unpartitioned window or sorts a whole class in one
task:

* ``ranked`` computes exact 1-based ranks inside groups from a
  range-partitioned global sort (hot groups spread over many partitions)
  plus per-partition row counts; the id-tagged sorted data is cut with a
  reliable checkpoint so the tags are stable under task retries.
* ``sample_n``, the stratified split and the rebalancing keep the rows up to a
  cut-off hash per class, which histograms of the hash's digits find
  (``select.cutoffs``): no row is sorted and wide rows are read once.
* hash-threshold splits need no shuffle at all.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .select import cutoffs, with_group


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(id_col, seed: int | str) -> Column:
    """Deterministic pseudo-random key: md5 hex of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(id_col).cast("string")))


def seeded_unit(id_col, seed: int | str) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded md5."""
    h = F.conv(F.substring(seeded_key(id_col, seed), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0)


def _join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group values back; NULL is a group like any other."""
    g = groups.select(*[_c(b).alias(f"__g_{i}") for i, b in enumerate(by)], *[c for c in groups.columns if c not in by])
    cond = reduce(lambda a, b: a & b, [df[b].eqNullSafe(g[f"__g_{i}"]) for i, b in enumerate(by)])
    return df.join(g, cond, how).drop(*[f"__g_{i}" for i in range(len(by))])


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (),
           name: str = "rank") -> DataFrame:
    """Exact 1-based rank inside ``by`` groups following ``order`` (unique
    order keys expected), without a per-group window.

    Global sort (range partitioning) -> partition id + in-partition position
    -> checkpoint -> per-partition counts (one row per partition) -> running
    offsets -> global rank; group start = ``min`` of the global rank.
    """
    s = df.orderBy(*[_c(b) for b in by], *order)
    s = s.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    cnt = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    # one row per partition: a bounded, tiny frame
    off = cnt.withColumn("__off", F.coalesce(F.sum("__c").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(F.broadcast(off.select("__pid", "__off")), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    s = s.withColumn("__g", F.col("__off") + local + 1)
    if by:
        start = s.groupBy(*by).agg(F.min("__g").alias("__start"))
        s = _join_groups(s, start, list(by)).withColumn(name, F.col("__g") - F.col("__start") + 1).drop("__start")
    else:
        s = s.withColumn(name, F.col("__g"))
    return s.drop("__pid", "__mid", "__off", "__g")


def stratified_split(df: DataFrame, label: str, test_size: float, id_col: str, seed: int = 42,
                     exact: bool = True, split_col: str = "split") -> DataFrame:
    """WN4: per class, the ``floor(test_size * n_class)`` rows with the
    smallest seeded hash are ``test``, the rest ``train``. ``exact=False``
    is the shuffle-free hash-threshold form (sizes exact in expectation)."""
    if not exact:
        return hash_split(df, test_size, id_col, seed, split_col)
    below = _drawn(df, [label], id_col, seed, F.floor(F.col("n") * test_size))
    return below.withColumn(split_col, F.when(F.col("__drawn"), "test").otherwise("train")).drop("__drawn")


def _drawn(df: DataFrame, by: Sequence[str], id_col: str, seed: int | str, wanted: Column, **more: Column) -> DataFrame:
    """``df`` with ``__drawn``: whether the row is among its class's ``wanted`` (a column over ``n``, the rows of the class, and
    ``more``) smallest seeded hashes, ties to the smaller id."""
    # without classes all rows share one that the optimizer cannot fold
    groups = [_c(b).alias(f"__b{i}") for i, b in enumerate(by)] or [(F.spark_partition_id() * 0).alias("__b0")]
    names = [f"__b{i}" for i in range(len(groups))]
    keyed = df.select(*groups, seeded_key(id_col, seed).alias("hash"), _c(id_col).alias("id"), *[c.alias(k) for k, c in more.items()])
    cuts = cutoffs(keyed, names, wanted).select(*names, "last")
    marked = with_group(df.withColumns(dict(zip(names, groups))), cuts, names, "left")
    here = F.struct(seeded_key(id_col, seed).alias("hash"), _c(id_col).alias("id"))
    return marked.withColumn("__drawn", F.coalesce(here <= F.col("last"), F.lit(False))).drop("last", *names)


def hash_split(df: DataFrame, test_size: float, id_col: str, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """WN5: unstratified seeded split by hash threshold (narrow, no shuffle)."""
    return df.withColumn(split_col, F.when(seeded_unit(id_col, seed) < test_size, "test").otherwise("train"))


def sample_n(df: DataFrame, n: int | Column, id_col: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """WN6 / WN9: the ``n`` rows (per ``by`` group) with the smallest seeded
    hash, ties to the smaller id. ``n`` may be a column that is the same in a group."""
    if isinstance(n, int):
        return _drawn(df, by, id_col, seed, F.lit(n)).where("__drawn").drop("__drawn")
    return _drawn(df, by, id_col, seed, F.col("__wanted"), __wanted=n).where("__drawn").drop("__drawn")


def rebalance(df: DataFrame, label: str, id_col: str, seed: int = 42, by: Sequence[str] = (),
              positive=1) -> DataFrame:
    """WN7: all positives plus as many seeded-sampled negatives (per ``by``)."""
    pos_cond = F.col(label) == positive
    pos = df.where(pos_cond)
    neg = df.where(~pos_cond | F.col(label).isNull())
    # negatives wanted in each class: its positives, counted beside them over all rows
    names = [f"__b{i}" for i in range(len(by))] or ["__b0"]
    groups = [_c(b).alias(n) for b, n in zip(by, names)] or [(F.spark_partition_id() * 0).alias("__b0")]
    npos = cut_lineage(pos.select(*groups).groupBy(*names).agg(F.count(F.lit(1)).alias("__npos")))
    wanted = with_group(neg.withColumns(dict(zip(names, groups))), npos, names)
    picked = _drawn(wanted, names, id_col, seed, F.col("__want"), __want=F.col("__npos")).where("__drawn").drop("__drawn", "__npos", *names)
    return pos.unionByName(picked)


def halve_class(df: DataFrame, label: str, value, id_col: str, seed: int = 42) -> DataFrame:
    """WN8: keep a seeded ``floor(n/2)`` of one class, every other row."""
    mine = F.coalesce(F.col(label) == value, F.lit(False))
    kept = _drawn(df.where(mine), (), id_col, seed, F.floor(F.col("n") / 2)).where("__drawn").drop("__drawn")
    return df.where(~mine).unionByName(kept)


def dedupe_first(df: DataFrame, key, order_col: str) -> DataFrame:
    """WN1: first row per key by ``order_col``; ``min_by`` is a mergeable
    aggregate, so a hot key is reduced map-side (no sort, no window)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def dup_flag(df: DataFrame, key, order_col: str, name: str = "duplicated") -> DataFrame:
    """WN2: true for second and later occurrences of a key."""
    keys = [key] if isinstance(key, str) else list(key)
    first = df.groupBy(*keys).agg(F.min(order_col).alias("__first"))
    return _join_groups(df, first, keys, "left").withColumn(name, F.col(order_col) > F.col("__first")).drop("__first")


# --- ordering (ST1-ST6) -----------------------------------------------------

def sort_by(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """ST1 / ST3: multi-key sort, mixed direction, NULLs last."""
    cols = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in spec]
    return df.orderBy(*cols)


def rank_expr(col, ranking: Sequence) -> Column:
    """Position of a value in a custom ranking (unknown values last)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in ranking]), _c(col))
    return F.when(pos > 0, pos).otherwise(F.lit(len(ranking) + 1))


def sort_rank(df: DataFrame, col: str, ranking: Sequence, then: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """ST2: custom order (e.g. Yes < Review < No), then other keys."""
    cols = [rank_expr(col, ranking)] + [
        F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in then]
    return df.orderBy(*cols)


def head_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """ST4: first ``n`` rows in an explicit order (top-k)."""
    return df.orderBy(order_col).limit(n)


def top_n(df: DataFrame, by: Sequence[str], score: str, n: int, tie: str) -> DataFrame:
    """ST5: top ``n`` rows per group by ``score`` desc, ties by ``tie`` asc.
    ``row_number() <= n`` plans with a partial WindowGroupLimit before the
    shuffle, so a hot group ships at most ``n`` rows per input partition."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def classes_sorted(conf_arr, labels_arr) -> Column:
    """ST6: a record's (confidence, label) pairs by confidence desc."""
    return F.sort_array(F.arrays_zip(_c(conf_arr).alias("conf"), _c(labels_arr).alias("label")), asc=False)
