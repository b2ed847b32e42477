"""Record linkage (JN11-JN17, AG16, WN3).

The reference links each transaction to a register of activities: same
organisation, year inside the activity's interval, then a cascade of
case-insensitive substring tests (identifier, title, short, long
description), where a stage wins with 1..5 matches.

Spark form: no per-row loops. Substring tests run as *equi-joins on an
index key* followed by an exact ``contains`` check:

* ``hash``: one anchor per needle of hashed grams (``operators/substring.py``);
  serves needles of every length.
* ``token``: if needle ``s`` (split on single blanks) has >= 3 pieces, each
  interior piece is a whole blank-separated token of any text containing
  ``s``. Join on (block, anchor token) against the exploded distinct tokens
  of the texts, then verify. The anchor is the needle's rarest interior
  token (document frequency), so hot tokens never drive the fan-out.
  Needles without interior tokens take ``hash``.

Both give the same pairs, so counts (and the 1..5 rule) are exact.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .substring import WIDEST, digest, substring_pairs


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dictionary lookups (JN11-JN13) ----------------------------------------

def lookup_last(dim: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """JN11: one row per key, the *last* value by ``order_col`` wins (a dict
    built in file order). ``max_by`` is a partial/final hash aggregate: no
    sort, no window."""
    return dim.groupBy(key).agg(F.max_by(F.col(value), F.col(order_col)).alias(value))


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """JN12: left lookup; an unmapped key yields NULL (no match)."""
    if dim_key and dim_key != key:
        dim = dim.withColumnRenamed(dim_key, key)
    return df.join(dim, key, "left")


def recode_override(code, mapping: Mapping, name, names: Sequence[str], value: str) -> Column:
    """JN13: recode a code through a dictionary, then let a name list override."""
    from ..functions.labels import recode
    return F.when(_c(name).isin(list(names)), F.lit(value)).otherwise(recode(code, mapping))


# --- date bounds and interval join (AG16, JN14) ----------------------------

def date_bounds(c, sep: str = "|", lo: int = 9999, hi: int = 0) -> tuple[Column, Column]:
    """AG16: (min_year, max_year) over a delimited date list, parsing the
    first four characters; unparsable pieces skipped; sentinels if none."""
    import re
    years = F.filter(F.transform(F.split(_c(c), re.escape(sep)),
                                 lambda x: F.substring(x, 1, 4).try_cast("int")),
                     lambda y: y.isNotNull())
    return (F.coalesce(F.array_min(years), F.lit(lo)), F.coalesce(F.array_max(years), F.lit(hi)))


def _aligned(b: DataFrame, lo: str, hi: str, key: str) -> DataFrame:
    """``b`` with a row per aligned block (k, n) of its interval: block n of level k holds the 2^k numbers from n * 2^k.
    At each level what is left of the interval, from ceil(lo / 2^k) to floor((hi + 1) / 2^k), gives its first block if that has no
    left sibling in it, and its last likewise: at most 2 log2(s) blocks of s numbers."""
    span = F.col(hi).cast("long") - F.col(lo).cast("long") + 1
    out = b.where(span > 0).withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(span.cast("double"))).cast("int") + 1)))
    left = -F.call_function("shiftright", -F.col(lo).cast("long"), F.col("__k"))
    right = F.call_function("shiftright", F.col(hi).cast("long") + 1, F.col("__k"))
    out = out.withColumns({"__l": left, "__r": right}).where("__l < __r")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    first, last = odd("__l"), odd("__r") & (F.col("__l") + odd("__l").cast("long") < F.col("__r"))
    blocks = F.array_compact(F.array(F.when(first, F.col("__l")), F.when(last, F.col("__r") - 1)))
    return out.withColumn("__n", F.explode(blocks)).withColumn(key, F.struct(F.col("__k").alias("k"), F.col("__n").alias("n"))).drop("__k", "__l", "__r", "__n")


def interval_join(a: DataFrame, b: DataFrame, block_a: str | None, block_b: str | None,
                  point: str, lo: str, hi: str, how: str = "inner") -> DataFrame:
    """JN14: ``a.block = b.block AND lo <= a.point <= hi`` for integer points
    (years).

    Intervals are cut into aligned blocks of 1, 2, 4, ... numbers, about two for
    each doubling of their length; a point names the one block of each length
    that holds it. The join is on (block, length, number) alone, so an interval of any
    length costs its few blocks and a hot block only its real matches: each pair
    meets in exactly one of them. Nulls match nothing.
    """
    if how != "inner":
        raise ValueError("interval_join supports inner; left-pad with a left join on the result")
    key = "__node"
    bx = _aligned(b, lo, hi, key)
    # the longest block in use bounds the lengths that a point names
    span = F.greatest(F.col(hi).cast("long") - F.col(lo).cast("long") + 1, F.lit(1))
    top = b.agg(F.coalesce(F.floor(F.log2(F.max(span).cast("double"))), F.lit(0)).cast("int").alias("k")).scalar()
    ax = a.withColumn("__k", F.explode(F.sequence(F.lit(0), top)))
    ax = ax.withColumn(key, F.struct("__k", F.call_function("shiftright", F.col(point).cast("long"), F.col("__k")).alias("n"))).drop("__k")
    cond = (ax[key]["__k"] == bx[key]["k"]) & (ax[key]["n"] == bx[key]["n"])
    if block_a:
        cond = (ax[block_a] == bx[block_b]) & cond
    return ax.join(bx, cond, "inner").drop(key)


# --- contains join (JN15, JN16) --------------------------------------------

def prefixed_id(ref, number) -> Column:
    """JN16: ``number`` if it already starts with the org ref, else ``ref-number``."""
    ref, number = _c(ref), _c(number)
    return F.when(number.isNull(), F.lit(None)).when(
        F.startswith(number, ref), number).otherwise(F.concat_ws("-", ref, number))


def _interior_tokens(s: Column) -> Column:
    toks = F.split(s, " ")
    return F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))


def _needle_pairs(needles: DataFrame, texts: DataFrame, method: str, anchor: str, df_sample: float, widest: int) -> DataFrame:
    """``__blk, __n, __b``: distinct needles ``__s`` (as digests) and the rows ``__b`` of texts ``__t`` of their block that hold them."""
    if method == "hash":
        return substring_pairs(needles, texts, widest)
    if method != "token":
        raise ValueError(method)
    A = needles.withColumn("__keys", F.array_distinct(_interior_tokens(F.col("__s"))))
    A = A.withColumn("__keys", F.filter("__keys", lambda x: x != ""))
    B = texts
    blk = ["__blk"]
    keys_of = lambda X: X.select("__b", "__h", *blk, F.explode(F.array_distinct(F.split("__t", " "))).alias("__k"))

    # Needles are matched once per (block, needle) and mapped back to their rows by
    # the caller; a text is found again by id and hash, so ids may repeat on both sides.
    indexable = A.where(F.size("__keys") > 0).dropDuplicates([*blk, "__s"])
    rest = A.where(F.size("__keys") == 0).drop("__keys")
    wanted = indexable.select(*blk, F.explode("__keys").alias("__k"))
    B = B.withColumn("__h", F.xxhash64("__t"))
    B_keys = keys_of(B).join(wanted.distinct(), blk + ["__k"], "left_semi")

    if anchor in ("rarest", "sampled"):
        stats = B_keys
        if anchor == "sampled":
            # sample register rows *before* tokenising: a cheap statistics pass
            from .sample import seeded_unit
            stats = keys_of(B.where(seeded_unit(F.col("__b").cast("string"), "df") < df_sample))
        df = stats.groupBy(*blk, "__k").agg(F.count(F.lit(1)).alias("__df"))
        ak = indexable.select(*blk, "__s", F.explode("__keys").alias("__k"))
        ak = ak.join(df, blk + ["__k"], "left").fillna(0, ["__df"])
        anchored = ak.groupBy(*blk, "__s").agg(F.min_by("__k", F.struct("__df", "__k")).alias("__k"))
    else:
        anchored = indexable.select(*blk, "__s", F.element_at(F.array_sort(F.transform(
            "__keys", lambda k: F.struct((-F.length(k)).alias("l"), k.alias("k")))), 1)["k"].alias("__k"))
    cand = anchored.join(B_keys, blk + ["__k"]).select(*blk, "__s", F.col("__b").alias("__cb"), F.col("__h").alias("__ch")).distinct()
    whole = B.select("__b", "__h", "__t", *[F.col(c).alias("__tblk") for c in blk])
    same = (F.col("__h") == F.col("__ch")) & F.col("__b").eqNullSafe(F.col("__cb")) & (F.col("__tblk") == F.col("__blk"))
    hits = cand.join(whole, same).where(F.contains(F.col("__t"), F.col("__s"))).select(*blk, digest(F.col("__s")).alias("__n"), "__b")
    return hits.unionByName(substring_pairs(rest, B.drop("__h"), widest))


def _needles(df: DataFrame, needle: str, block: str | None) -> DataFrame:
    block = F.col(block) if block else F.lit(0)
    return df.select("*", F.lower(F.col(needle)).alias("__s"), block.alias("__blk")).where(F.col("__s") != "")


def _texts(b: DataFrame, b_id: str, text: str, block: str | None) -> DataFrame:
    block = F.col(block) if block else F.lit(0)
    return b.select(F.col(b_id).alias("__b"), F.lower(F.col(text)).alias("__t"), block.alias("__blk")).where(F.col("__t").isNotNull())


def contains_join(a: DataFrame, b: DataFrame, a_id: str, needle: str, b_id: str, text: str,
                  block_a: str | None = None, block_b: str | None = None,
                  method: str = "hash", anchor: str = "rarest", df_sample: float = 0.05) -> DataFrame:
    """JN15: all pairs (a_id, b_id) where lower(needle) is a substring of
    lower(text), within equal blocks. Returns ``a_id, b_id``. An empty needle
    says nothing about a text and gives no pairs.

    ``method`` = ``hash`` | ``token`` (see module doc). ``anchor``, for tokens,
    = ``rarest`` (document frequency over all of ``b``, robust to hot
    tokens), ``sampled`` (the same frequencies estimated on a seeded
    ``df_sample`` share of ``b``: a cheap statistics pass; the pairs stay
    exact, only the choice of index key uses the estimate) or ``longest``
    (no frequency pass).
    """
    A = _needles(a.select(F.col(a_id).alias("__a"), F.col(needle).alias("__raw"), *([F.col(block_a).alias("__ablk")] if block_a else [])),
                 "__raw", "__ablk" if block_a else None)
    pairs = _needle_pairs(A.select("__blk", "__s"), _texts(b, b_id, text, block_b), method, anchor, df_sample, WIDEST)
    out = A.select("__a", "__blk", digest(F.col("__s")).alias("__n")).join(pairs, ["__blk", "__n"]).select("__a", "__b")
    return out.withColumnsRenamed({"__a": a_id, "__b": b_id})


# --- cascade (JN17) --------------------------------------------------------

STAGES = ("identifier", "project title", "short description", "long description")


def link_cascade(a: DataFrame, b: DataFrame, *, a_id: str, a_block: str | None,
                 number: str | None, texts: Sequence[str], b_pos: str, b_ident: str,
                 b_text: str, b_block: str | None, year: str | None = None,
                 b_lo: str | None = None, b_hi: str | None = None,
                 max_matches: int = 5, min_len: int = 20,
                 text_method: str = "hash", id_method: str = "hash", anchor: str = "rarest",
                 stage_names: Sequence[str] = STAGES, over: str | None = None) -> DataFrame:
    """JN17: cascading linkage.

    ``a``: one row per transaction with its block (org ref), optional year,
    ``number`` (identifier stage; made ``ref-number`` unless it already
    starts with the ref) and the stage texts in order. ``b``: the register
    with position ``b_pos`` (its order), identifier, text, block, and the
    optional year interval ``[b_lo, b_hi]``.

    A stage counts matches over the whole candidate set (same block, year in
    interval); ``1 <= n <= max_matches`` wins, otherwise (0 or too many) the
    next stage is tried. NULL needles skip a stage; text needles must be
    longer than ``min_len``. Output: ``a`` plus ``matched_identifier``,
    ``matched_text``, ``match_type`` ("" when unmatched) and, if ``over`` names it, whether
    some stage had more than ``max_matches``.
    """
    cols = [a_id] + ([a_block] if a_block else [])
    base = a.select(*cols, *([number] if number else []), *texts)

    def counted(needles, text, method, widest):
        """Matches and first position by (row, stage). Needles are counted once per (block, needle) and (year interval), so
        equal needles of many rows never multiply with their texts."""
        needles = _needles(needles, "__raw", a_block)
        hits = _needle_pairs(needles.select("__blk", "__s"), _texts(b, b_pos, text, b_block), method, anchor, 0.05, widest)
        rows = needles.select(F.col(a_id).alias("__a"), "__stage", "__blk", digest(F.col("__s")).alias("__n"))
        if year:
            hits = hits.join(b.select(F.col(b_pos).alias("__b"), F.col(b_lo).alias("__lo"), F.col(b_hi).alias("__hi")), "__b")
            rows = rows.join(a.select(F.col(a_id).alias("__a"), F.col(year).alias("__yr")), "__a")
        hits = hits.groupBy("__blk", "__n", *(["__lo", "__hi"] if year else [])).agg(
            F.count(F.lit(1)).alias("__n_hits"), F.min("__b").alias("__least"))
        rows = rows.join(hits, ["__blk", "__n"])
        if year:
            rows = rows.where((F.col("__yr") >= F.col("__lo")) & (F.col("__yr") <= F.col("__hi")))
        return rows.select("__a", "__stage", "__n_hits", "__least")

    parts = []
    # stage 0: identifier needles against identifiers, which share their beginnings: all their grams are indexed
    if number:
        ids = base.select(*cols, F.lit(0).alias("__stage"), prefixed_id(F.col(a_block) if a_block else F.lit(""), number).alias("__raw"))
        parts.append(counted(ids, b_ident, id_method, 1))
    # text stages: needles stacked as (a_id, stage, needle) -> one join
    stacked = base.select(*cols, F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("stage"), F.col(t).alias("needle")) for i, t in enumerate(texts)
    ])).alias("__st")).select(*cols, F.col("__st.stage").alias("__stage"), F.col("__st.needle").alias("__raw"))
    stacked = stacked.where(F.col("__raw").isNotNull() & (F.length("__raw") > min_len))
    parts.append(counted(stacked, b_text, text_method, WIDEST))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    per_stage = pairs.groupBy(F.col("__a").alias(a_id), "__stage").agg(F.sum("__n_hits").alias("__n"), F.min("__least").alias("__first"))
    wins = F.when(F.col("__n") <= max_matches, F.col("__stage"))
    winner = per_stage.groupBy(a_id).agg(F.min_by(F.struct("__stage", "__first"), wins).alias("__w"),
                                         (F.max("__n") > max_matches).alias("__over"))
    names = F.array(*[F.lit(s) for s in stage_names])
    bt = b.select(F.col(b_pos).alias("__first"), F.col(b_ident).alias("matched_identifier"),
                  F.col(b_text).alias("matched_text"))
    w = winner.select(a_id, F.col("__w.__stage").alias("__stage"), F.col("__w.__first").alias("__first"), "__over")
    # texts join last, so that they are shuffled once
    out = a.join(w, a_id, "left").join(bt, "__first", "left").select(*a.columns, "__stage", "__over", "matched_identifier", "matched_text")
    return out.withColumns({
        "matched_identifier": F.coalesce(F.col("matched_identifier"), F.lit("")),
        "matched_text": F.coalesce(F.col("matched_text"), F.lit("")),
        "match_type": F.when(F.col("__stage").isNull(), F.lit("")).otherwise(
            F.try_element_at(names, F.col("__stage") + 1)),
        **({over: F.coalesce("__over", F.lit(False))} if over else {}),
    }).drop("__stage", "__over")


def first_match(df: DataFrame, key: str, order_col: str, cols: Sequence[str]) -> DataFrame:
    """WN3: per key, the row first in ``order_col`` (``min_by``, no sort)."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.col(order_col)).alias(c) for c in cols])
