"""Joins, set operations and assertions (JN1-JN10, JN19, SET1-SET8, AST1-AST2).

Keys may hold NULL in the reference's data and R/pandas merges match NULL
with NULL, so every multi-key join here compares keys with ``<=>``
(``eqNullSafe``). ``<=>`` stays an equi-join: Catalyst plans it as a hash or
sort-merge join on ``(coalesce(k), isnull(k))`` pairs, never a nested loop.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast

_H = "__kh"


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _nullsafe_cond(a: DataFrame, b: DataFrame, keys: Sequence[str],
                   b_keys: Sequence[str] | None = None) -> Column:
    b_keys = b_keys or keys
    cond = None
    for ka, kb in zip(keys, b_keys):
        c = a[ka].eqNullSafe(b[kb])
        cond = c if cond is None else cond & c
    return cond


def full_merge(a: DataFrame, b: DataFrame, keys, how: str = "full",
               suffixes: tuple[str, str] = ("_x", "_y"), hash_key: bool = True) -> DataFrame:
    """JN2 (and JN6/JN7 forms): merge on ``keys`` with NULL = NULL.

    Key columns come out once (coalesced for full joins). Non-key columns
    present on both sides get ``suffixes``. With ``hash_key`` one
    ``xxhash64`` of all keys is added as the leading equi-key, so a merge on
    many keys shuffles and sorts on one long (``<=>`` still decides).
    """
    keys = _keys(keys)
    shared = set(a.columns) & set(b.columns) - set(keys)
    a2 = a.toDF(*[f"{c}{suffixes[0]}" if c in shared else c for c in a.columns])
    b2 = b.toDF(*[f"{c}{suffixes[1]}" if c in shared else c for c in b.columns])
    a2 = a2.select(*[F.col(f"`{c}`").alias(f"a__{c}") if c in keys else F.col(f"`{c}`") for c in a2.columns])
    b2 = b2.select(*[F.col(f"`{c}`").alias(f"b__{c}") if c in keys else F.col(f"`{c}`") for c in b2.columns])
    ak, bk = [f"a__{k}" for k in keys], [f"b__{k}" for k in keys]
    cond = _nullsafe_cond(a2, b2, ak, bk)
    if hash_key and len(keys) > 1:
        a2 = a2.withColumn(_H + "a", F.xxhash64(*ak))
        b2 = b2.withColumn(_H + "b", F.xxhash64(*bk))
        cond = (a2[_H + "a"] == b2[_H + "b"]) & cond
    j = a2.join(b2, cond, how)
    if how in ("full", "outer", "full_outer"):
        kcols = [F.coalesce(F.col(x), F.col(y)).alias(k) for k, x, y in zip(keys, ak, bk)]
    elif how == "right":
        kcols = [F.col(y).alias(k) for k, y in zip(keys, bk)]
    else:
        kcols = [F.col(x).alias(k) for k, x in zip(keys, ak)]
    rest = [F.col(f"`{c}`") for c in j.columns
            if c not in ak + bk and not c.startswith(_H)]
    return j.select(*kcols, *rest)


def merge_coalesce(a: DataFrame, b: DataFrame, keys, cols: Sequence[str],
                   suffixes: tuple[str, str] = ("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """JN3: full null-safe merge, then for each shared column take the left
    value else the right one. Returns ``(merged, conflicts)``: ``conflicts``
    holds the rows where both sides are set and disagree (AST1 input; the
    reference stops when it is non-empty)."""
    m = full_merge(a, b, keys, "full", suffixes)
    x = lambda c: F.col(f"`{c}{suffixes[0]}`")
    y = lambda c: F.col(f"`{c}{suffixes[1]}`")
    clash = F.lit(False)
    for c in cols:
        clash = clash | F.coalesce(x(c) != y(c), F.lit(False))
    m = m.withColumn("__conflict", clash)
    conflicts = m.where("__conflict").drop("__conflict")
    merged = m.select(*[F.col(f"`{c}`") for c in m.columns
                        if c != "__conflict" and not any(c == f"{k}{s}" for k in cols for s in suffixes)],
                      *[F.coalesce(x(c), y(c)).alias(c) for c in cols],
                      F.col("__conflict").alias("conflict"))
    return merged, conflicts


def attach_features(df: DataFrame, feats: DataFrame, key: str = "text", how: str = "left",
                    hash_key: bool = True) -> DataFrame:
    """JN1: attach categorical features by a (long) text key after removing
    duplicate feature rows. Several distinct feature rows per key fan out,
    as in the reference. ``hash_key`` joins on ``xxhash64(key)`` first, so the
    shuffle sorts on a long instead of the whole text."""
    f = feats.dropDuplicates()
    if not hash_key:
        return df.join(f, key, how)
    d2 = df.withColumn(_H, F.xxhash64(key))
    f2 = f.withColumnRenamed(key, "__fk").withColumn(_H + "f", F.xxhash64("__fk"))
    j = d2.join(f2, (d2[_H] == f2[_H + "f"]) & (d2[key] == f2["__fk"]), how)
    return j.drop(_H, _H + "f", "__fk")


def dim_join(df: DataFrame, dim: DataFrame, keys, defaults: Mapping | None = None,
             max_dim_rows: int = 1_000_000) -> DataFrame:
    """JN4/JN5: left join to a dimension (broadcast when it is provably
    small, else shuffled), NULL = NULL, then default the unmatched dimension columns."""
    keys = _keys(keys)
    dim = sized_broadcast(dim.withColumnsRenamed({k: f"__dim_{k}" for k in keys}), max_dim_rows)
    out = df.join(dim, _nullsafe_cond(df, dim, keys, [f"__dim_{k}" for k in keys]), "left").drop(*[f"__dim_{k}" for k in keys])
    return out.fillna(dict(defaults)) if defaults else out


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """JN6: join on every shared column name, NULL = NULL."""
    from .project import common_cols
    keys = common_cols(a, b)
    return full_merge(a, b, keys, how)


def reviewed_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """JN7: right join keeping every reviewed (``b``) row."""
    return full_merge(a, b, keys, "right")


def semi(a: DataFrame, b: DataFrame, keys, b_keys=None) -> DataFrame:
    """JN8 / SET5: rows of ``a`` whose key occurs in ``b`` (NULL matches NULL,
    like R ``%in%``)."""
    keys = _keys(keys)
    return a.join(b, _nullsafe_cond(a, b, keys, _keys(b_keys) if b_keys else None), "left_semi")


def anti(a: DataFrame, b: DataFrame, keys, b_keys=None) -> DataFrame:
    """JN9: rows of ``a`` whose key is absent from ``b``; never ``NOT IN``,
    which drops everything once ``b`` holds a NULL."""
    keys = _keys(keys)
    return a.join(b, _nullsafe_cond(a, b, keys, _keys(b_keys) if b_keys else None), "left_anti")


def semi_or(a: DataFrame, b: DataFrame, keys, pred: Column) -> DataFrame:
    """JN10: ``key %in% b | pred``: left join to the distinct keys of ``b``
    with a presence flag, then one filter."""
    keys = _keys(keys)
    bk = b.select(*[F.col(k).alias(f"__b_{k}") for k in keys]).distinct().withColumn("__in", F.lit(True))
    j = a.join(bk, _nullsafe_cond(a, bk, keys, [f"__b_{k}" for k in keys]), "left")
    return j.where(F.coalesce(F.col("__in"), F.lit(False)) | F.coalesce(pred, F.lit(False))) \
        .drop("__in", *[f"__b_{k}" for k in keys])


def patch(df: DataFrame, overrides: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """JN19: for keys listed in ``overrides`` replace ``cols`` by the new values."""
    o = overrides.select(F.col(key).alias("__pk"), *[F.col(c).alias(f"__new_{c}") for c in cols])
    j = df.join(o, df[key].eqNullSafe(o["__pk"]), "left")
    return j.withColumns({c: F.when(F.col("__pk").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c))
                          for c in cols}).drop("__pk", *[f"__new_{c}" for c in cols])


# --- set operations --------------------------------------------------------

def union_all(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    """SET1: union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def distinct(df: DataFrame) -> DataFrame:
    """SET2."""
    return df.distinct()


def except_keys(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None,
                drop_null: bool = True) -> DataFrame:
    """SET3: distinct keys of ``a`` not in ``b`` (R ``setdiff``), NULL dropped."""
    ka = a.select(F.col(key).alias(key)).distinct()
    kb = b.select(F.col(b_key or key).alias(key)).distinct()
    out = ka.subtract(kb)
    return out.where(F.col(key).isNotNull()) if drop_null else out


def unique_values(df: DataFrame, col: str) -> DataFrame:
    """SET4."""
    return df.select(col).distinct()


def known_keys(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """SET5: distinct keys of ``a`` that occur in ``b``."""
    ka = a.select(key).distinct()
    kb = b.select(F.col(b_key or key).alias("__k"))
    return ka.join(kb, ka[key].eqNullSafe(kb["__k"]), "left_semi")


def set_partition(a: DataFrame, b: DataFrame, cols: Sequence[str],
                  names: tuple[str, str, str] = ("A only", "B only", "both")) -> DataFrame:
    """SET6: label each distinct row of ``a`` and ``b`` as A only, B only or both."""
    da = a.select(*cols).distinct().withColumn("__a", F.lit(True))
    db = b.select(*cols).distinct().withColumn("__b", F.lit(True))
    m = full_merge(da, db, cols, "full")
    side = (F.when(F.col("__a") & F.col("__b"), names[2])
            .when(F.col("__a"), names[0]).otherwise(names[1]))
    return m.select(*cols, side.alias("side"))


def unrelated(candidates: Sequence[DataFrame], related: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET7: distinct union of the candidate sets minus the related rows."""
    u = union_all(*[c.select(*cols) for c in candidates]).distinct()
    return anti(u, related.select(*cols), list(cols))


def exclusive_terms(df: DataFrame, term: str = "term", priority: str = "priority") -> DataFrame:
    """SET8: successive exclusion of term lists: a term stays only in the
    group of lowest priority that lists it (cf - unrelated; paf - unrelated -
    cf; ...). One aggregation per term, then a semi join."""
    m = df.groupBy(term).agg(F.min(priority).alias("__p"))
    return df.join(m, (df[term] == m[term]) & (df[priority] == m["__p"]), "left_semi")


# --- assertions ------------------------------------------------------------

def expect_empty(name: str, df: DataFrame) -> DataFrame:
    """AST1: one report row ``(check, violations)``; zero means it holds."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), "violations")


def expect_unique(name: str, df: DataFrame, key) -> DataFrame:
    """AST2: number of keys that occur more than once."""
    keys = _keys(key)
    dup = df.groupBy(*keys).count().where(F.col("count") > 1)
    return expect_empty(name, dup)


def assert_report(checks: Iterable[DataFrame]) -> DataFrame:
    return union_all(*checks)
