"""Aggregations and evaluation metrics (AG1-AG14, AG17-AG25).

Everything is a grouped or global aggregate with partial (map-side)
aggregation; ratios use ``try_divide`` so empty denominators give NULL,
turned into 0 where the reference reports 0.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .select import exact_quantiles


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AG1."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def describe_col(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """AG2: n, missing and distinct per column, in one pass; one row per column.
    ``approx`` uses HyperLogLog++ for the distinct count (no per-value state)."""
    aggs = []
    for c in cols:
        d = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        aggs += [F.count(F.lit(1)).alias(f"n__{c}"),
                 F.count_if(F.col(c).isNull()).alias(f"missing__{c}"), d.alias(f"distinct__{c}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n__{c}").alias("n"),
                     F.col(f"missing__{c}").alias("missing"), F.col(f"distinct__{c}").alias("distinct"))
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


TRACKED = 4096


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """AG2: the ``k`` most frequent values of a column with exact counts and shares of the rows (NULL is no value), ties to the smaller.

    A mergeable sketch of ``TRACKED`` counters names the candidates and how far
    its estimates may be off; a value it does not name has at most that many
    rows. The candidates alone are counted again, by a lookup of bounded
    size. Only where the k-th exact count does not exceed what an unnamed value
    may have is every value counted.
    """
    c = F.col(col)
    rows = df.select(c.alias("value"))
    total = rows.count()
    sketch = rows.where("value is not null").agg(F.call_function("approx_top_k", F.col("value"), F.lit(TRACKED // 2), F.lit(TRACKED)).alias("s"))
    named = cut_lineage(sketch.select(F.explode("s").alias("x")).select("x.item").distinct())
    counted = rows.join(F.broadcast(named), rows["value"] == named["item"], "left_semi")
    best = cut_lineage(counted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k))
    weakest = best.agg(F.count(F.lit(1)).alias("found"), F.min("n").alias("n")).first()
    # the sketch's counters hold 3/4 of their table; an item not named has at most 3.5 / TRACKED of the rows
    if weakest["found"] < k or weakest["n"] <= 3.5 * total / TRACKED:
        best = rows.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return best.select("value", "n", (F.col("n") / F.lit(total)).alias("share"))


def share(cond) -> Column:
    """AG3: prevalence of a boolean (NULL counts as false)."""
    return F.avg(F.coalesce(_c(cond), F.lit(False)).cast("double"))


def coverage(c) -> Column:
    """AG3: share of non-NULL values."""
    return F.avg(_c(c).isNotNull().cast("double"))


def funnel(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AG4: share of the first flag, then the rate of each flag within the
    rows that hold all previous flags."""
    aggs, prev = [], F.lit(True)
    for i, f in enumerate(flags):
        cur = prev & F.coalesce(F.col(f), F.lit(False))
        aggs.append(F.try_divide(F.count_if(cur).cast("double"), F.count_if(prev).cast("double"))
                    .alias(f"rate_{i + 1}"))
        prev = cur
    return df.groupBy(*by).agg(*aggs)


QUANTS = (0.05, 0.10, 0.5, 0.90, 0.95)


def quantile_summary(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """AG5: min, p5, p10, mean, median, p90, p95, max with NULLs removed.

    ``approx=False`` is R's default type-7 (linear interpolation) quantile, by
    selection without a sort (``exact_quantiles``); ``approx=True`` uses the
    Greenwald-Khanna sketch alone (``percentile_approx``).
    """
    c = F.col(col)
    names = ["min", "p5", "p10", "mean", "median", "p90", "p95", "max"]
    if not approx:
        g = exact_quantiles(df, col, by, QUANTS).withColumnsRenamed({f"q{i}": n for i, n in enumerate(["p5", "p10", "median", "p90", "p95"])})
        kind = df.schema[col].dataType
        return g.select(*by, F.col("min").cast(kind).alias("min"), *names[1:-1], F.col("max").cast(kind).alias("max"))
    g = df.where(c.isNotNull()).groupBy(*by).agg(
        F.min(c).alias("min"), F.percentile_approx(c, list(QUANTS), accuracy).alias("__q"), F.avg(c).alias("mean"), F.max(c).alias("max"))
    q = dict(zip(["p5", "p10", "median", "p90", "p95"], range(5)))
    return g.select(*by, *[F.col("__q")[q[n]].alias(n) if n in q else n for n in names])


def outcome_summary(df: DataFrame, labels: Mapping[str, tuple[str, str, str]],
                    approx: bool = False) -> DataFrame:
    """AG6: AG5 of the confidence over outcome slices per label:
    actual true, false positive, false negative.
    ``labels``: name -> (actual col, predicted col, confidence col)."""
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(a).alias("actual"),
                                      F.col(p).alias("predicted"), F.col(c).alias("conf"))
                             for n, (a, p, c) in labels.items()])).alias("s")
    long = df.select(st).select("s.*")
    oc = F.explode(F.array(
        F.when(F.col("actual"), F.lit("actual true")),
        F.when(~F.col("actual") & F.col("predicted"), F.lit("false positive")),
        F.when(F.col("actual") & ~F.col("predicted"), F.lit("false negative"))))
    long = long.select("label", "conf", oc.alias("outcome")).where(F.col("outcome").isNotNull())
    return quantile_summary(long, "conf", ["label", "outcome"], approx)


def bucket(c, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bucket: 0 below ``lo``, ``bins+1`` at or above ``hi``."""
    c = _c(c)
    return (F.when(c < lo, 0).when(c >= hi, bins + 1)
            .otherwise(F.floor((c - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)) + 1)).cast("int")


def histogram(df: DataFrame, col, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """AG7: counts per equal-width bucket."""
    return df.where(_c(col).isNotNull()).groupBy(*by, bucket(col, lo, hi, bins).alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _cm_aggs(actual: Column, predicted: Column):
    a = F.coalesce(actual, F.lit(False))
    p = F.coalesce(predicted, F.lit(False))
    return [F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"),
            F.count_if(a & ~p).alias("fn"), F.count_if(a & p).alias("tp")]


def confusion(df: DataFrame, actual, predicted, by: Sequence[str] = ()) -> DataFrame:
    """AG8: zero-filled binary confusion matrix as one row (tn, fp, fn, tp)."""
    return df.groupBy(*by).agg(*_cm_aggs(_c(actual), _c(predicted)))


def confusion_multilabel(df: DataFrame, labels: Mapping[str, tuple[str, str]]) -> DataFrame:
    """AG9: one confusion row per label in a single pass (unpivot, group)."""
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(a).alias("actual"),
                                      F.col(p).alias("predicted")) for n, (a, p) in labels.items()]))
    long = df.select(st.alias("s")).select("s.*")
    return confusion(long, "actual", "predicted", ["label"])


def metrics(cm: DataFrame) -> DataFrame:
    """AG10: accuracy, precision, recall, F1 from (tn, fp, fn, tp);
    0 when a denominator is empty. Named arguments, so precision and recall
    cannot be swapped."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    prec = z(F.try_divide(tp, tp + fp))
    rec = z(F.try_divide(tp, tp + fn))
    return cm.select("*", z(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                     prec.alias("precision"), rec.alias("recall"),
                     z(F.try_divide(2 * prec * rec, prec + rec)).alias("f1"))


def metrics_micro(df: DataFrame, actual_arr: str, pred_arr: str) -> DataFrame:
    """AG11: micro-averaged metrics over all label slots. Slot counts are
    summed per row with array functions (no explode)."""
    z = F.arrays_zip(F.col(actual_arr).alias("a"), F.col(pred_arr).alias("p"))
    cnt = lambda f: F.size(F.filter(z, f))
    a = lambda x: x["a"] > 0.5
    p = lambda x: x["p"] > 0.5
    cm = df.agg(F.sum(cnt(lambda x: ~a(x) & ~p(x))).alias("tn"),
                F.sum(cnt(lambda x: ~a(x) & p(x))).alias("fp"),
                F.sum(cnt(lambda x: a(x) & ~p(x))).alias("fn"),
                F.sum(cnt(lambda x: a(x) & p(x))).alias("tp"))
    return metrics(cm)


def exact_match(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """AG12: share of rows where every (actual, predicted) pair agrees."""
    ok = F.lit(True)
    for a, p in pairs:
        ok = ok & F.col(a).eqNullSafe(F.col(p))
    return df.agg(F.avg(ok.cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, labels: Mapping[str, str], kind: str = "neg_pos") -> DataFrame:
    """AG13 (``neg_pos``: negatives / positives per label column) and AG14
    (``total_class``: total / count of each class of one label column)."""
    if kind == "neg_pos":
        rows = [F.struct(F.lit(n).alias("label"),
                         F.try_divide(F.count_if(~F.coalesce(F.col(c), F.lit(False))).cast("double"),
                                      F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("double")).alias("weight"))
                for n, c in labels.items()]
        return df.agg(F.array(*rows).alias("w")).select(F.explode("w").alias("w")).select("w.*")
    (name, col), = labels.items()
    total = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(F.col(col).alias("class")).agg(F.count(F.lit(1)).alias("n")) \
        .select("class", (total / F.col("n")).alias("weight"))


def duplicate_counts(df: DataFrame, key) -> DataFrame:
    """AG17: occurrences beyond the first, per duplicated key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).where(F.col("extra") > 0)


def overlap_count(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG18: rows of the union that duplicate an earlier row
    (``count(*) - count(distinct row)``)."""
    u = a.select(*cols).unionByName(b.select(*cols))
    d = u.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return d.agg((F.sum("__n") - F.count(F.lit(1))).alias("overlap"))


def label_prevalence(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """AG19: count and percent of rows carrying each label of a delimited
    list (membership per row; one grouped pass, no label x row pairs)."""
    labs = F.array_distinct(F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x)),
                                     lambda x: x != ""))
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.select(F.explode(labs).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", F.round(100.0 * F.col("n") / total, 2).alias("pct"))


def length_share(df: DataFrame, col: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """AG20: share of texts with more than ``n`` blank-separated tokens."""
    size = F.size(F.split(F.col(col), " "))
    return df.groupBy(*by).agg(F.avg((size > n).cast("double")).alias("share_long"),
                               F.max(size).alias("max_tokens"))


def miss_rate(known: DataFrame, found: DataFrame, register: DataFrame, key: str) -> DataFrame:
    """AG21: share of known keys (those present in the register) that the
    automatic run did not find."""
    from .merge import except_keys, known_keys
    kk = known_keys(known, register, key)
    missed = except_keys(kk, found, key)
    n_known = kk.select(F.count(F.lit(1))).scalar()
    return missed.agg(F.count(F.lit(1)).alias("missed")).select(
        "missed", n_known.alias("known"),
        F.coalesce(F.try_divide(F.col("missed").cast("double"), n_known.cast("double")), F.lit(0.0)).alias("miss_rate"))


def token_cost(df: DataFrame, cols: Sequence[str], multiplier: float = 1.0,
               price_per_1k: float = 0.0) -> DataFrame:
    """AG23: total blank-separated tokens of the columns and the job cost."""
    tok = None
    for c in cols:
        t = F.coalesce(F.size(F.filter(F.split(F.col(c), " "), lambda x: x != "")), F.lit(0))
        tok = t if tok is None else tok + t
    return df.agg(F.sum(tok).alias("tokens")).select(
        "tokens", (F.col("tokens") * multiplier / 1000.0 * price_per_1k).alias("cost"))


def group_term_counts(df: DataFrame, group: str, text: str) -> DataFrame:
    """AG24: term counts per group: the vector of the group's concatenated
    text, without building the concatenation."""
    return df.select(group, F.explode(F.split(F.col(text), " ")).alias("term")) \
        .where(F.col("term") != "").groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))


def pseudo_r2(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """AG25: 1 - residual sum of squares / total sum of squares (Gaussian
    deviance ratio); the mean is a scalar subquery."""
    mean = df.select(F.avg(y)).scalar()
    return df.agg(F.sum((F.col(y) - F.col(yhat)) ** 2).alias("deviance"),
                  F.sum((F.col(y) - mean) ** 2).alias("null_deviance")).select(
        "deviance", "null_deviance", (1 - F.col("deviance") / F.col("null_deviance")).alias("r2"))
