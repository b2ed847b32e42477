"""Selection by rank without sorting rows (AG5, AG6, WN4, WN6-WN9).

``exact_quantiles``: a mergeable sketch brackets each quantile of each group, one
scan counts what lies below, histograms narrow a bracket that still holds
more than ``INSIDE`` values, and only the values inside the last brackets are
put in order. ``cutoffs``: the k rows of a class with the smallest seeded
hashes are those up to a cut-off, found from histograms of the hash's
leading digits. All partial results are mergeable, so a group of any size is
spread over all tasks, and what meets in one task is bounded by ``INSIDE`` values or
one histogram.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

INSIDE = 10_000
ACCURACY = 10_000
SLICES = 1024
FEW_GROUPS = 10_000
SALTS = 16
#: A histogram slice is an interval of values; values so unlike that slices do not part them are ordered after this many rounds.
ROUNDS = 12


def with_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", few: bool | None = None) -> DataFrame:
    """Rows with their group's values; NULL is a group. ``groups`` (a row per group) is broadcast if it has at most
    ``FEW_GROUPS`` rows (``few``; counted here if not given); beyond, its rows are repeated under salts, so a large group is spread."""
    values = [c for c in groups.columns if c not in keys]
    groups = groups.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *values)
    same = [rows[k].eqNullSafe(groups[f"__k{i}"]) for i, k in enumerate(keys)]
    if few if few is not None else groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        out = rows.join(F.broadcast(groups), reduce(lambda a, b: a & b, same, F.lit(True)), how)
        return out.drop(*[f"__k{i}" for i in range(len(keys))])
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("__gsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [rows[k].eqNullSafe(groups[f"__k{i}"]) for i, k in enumerate(keys)] + [rows["__salt"] == groups["__gsalt"]]
    return rows.join(groups, reduce(lambda a, b: a & b, same), how).drop("__salt", "__gsalt", *[f"__k{i}" for i in range(len(keys))])


def _fold(counts: Column, rank: Column, value: Callable[[Column], Column], kind: str) -> Column:
    """The first entry of (x, n) in order whose running sum of n exceeds ``rank`` (from 0)."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast(kind).alias("found"))
    return F.aggregate(counts, start, lambda a, x: F.struct(
        (a["sum"] + x["n"]).alias("sum"), F.when(a["found"].isNull() & (a["sum"] + x["n"] > rank), value(x)).otherwise(a["found"]).alias("found")),
        lambda a: a["found"])


def exact_quantiles(df: DataFrame, col: str, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``by, n, min, mean, max, q0, q1, ...``: type-7 quantiles (linear between neighbours) of each group.

    NULL and NaN are missing values. A group without values has no row (without ``by`` and values: no row).
    """
    # without groups all rows share one that the optimizer cannot fold, so that joins keep a key
    groups = [F.col(c) for c in by] or [F.spark_partition_id() * 0]
    keys = [f"__g{i}" for i in range(len(groups))]
    v, targets = F.col("__v"), range(len(probs))
    rows = df.select(*[g.alias(k) for g, k in zip(groups, keys)], F.col(col).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    ends = [min(max(p + d / ACCURACY, 0.0), 1.0) for p in probs for d in (-2, 2)]
    stats = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"),
                                    F.percentile_approx(v, ends, ACCURACY).alias("s")).where("n > 0")
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    small = F.col("n") <= INSIDE
    stats = cut_lineage(stats.select(
        *keys, "n", "min", "mean", "max", *[F.when(small, F.col("min")).otherwise(F.col("s")[2 * i]).alias(f"a{i}") for i in targets],
        *[F.when(small, F.col("max")).otherwise(F.col("s")[2 * i + 1]).alias(f"b{i}") for i in targets]))
    size = stats.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n")).first()
    few = size["groups"] * len(probs) <= FEW_GROUPS
    counts = with_group(rows, stats, keys, few=few).groupBy(*keys).agg(
        *[F.count_if(v < F.col(f"a{i}")).alias(f"below{i}") for i in targets], *[F.count_if(v <= F.col(f"b{i}")).alias(f"upto{i}") for i in targets])
    known = with_group(stats, counts, keys, few=few)
    # a sketch that missed its rank gives way to the whole range
    held = [(F.col(f"below{i}") <= F.floor(place[i])) & (F.col(f"upto{i}") > F.ceil(place[i])) for i in targets]
    bracket = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), place[i].alias("place"), F.when(held[i], F.col(f"a{i}")).otherwise(F.col("min")).alias("a"),
        F.when(held[i], F.col(f"b{i}")).otherwise(F.col("max")).alias("b"), F.when(held[i], F.col(f"below{i}")).otherwise(F.lit(0)).alias("below"),
        F.when(held[i], F.col(f"upto{i}") - F.col(f"below{i}")).otherwise(F.col("n")).alias("inside")) for i in targets])).alias("t")
    brackets = cut_lineage(known.select(*keys, bracket).select(*keys, "t.*"))

    def inside(brackets: DataFrame) -> DataFrame:
        lists = brackets.groupBy(*keys).agg(F.collect_list(F.struct("i", "a", "b")).alias("__t"))
        found = with_group(rows, lists, keys, few=few)
        hit = F.filter("__t", lambda t: (v >= t["a"]) & (v <= t["b"]))
        return found.select(*keys, "__v", F.explode(hit).alias("t")).select(*keys, "__v", "t.*")

    for _ in range(ROUNDS if (size["n"] or 0) > INSIDE else 0):
        wide = brackets.where((F.col("inside") > INSIDE) & (F.col("a") < F.col("b")))
        if wide.isEmpty():
            break
        slice_ = F.least(F.floor((v - F.col("a")) / (F.col("b") - F.col("a")) * SLICES), F.lit(SLICES - 1)).alias("slice")
        hist = inside(wide).groupBy(*keys, "i", slice_).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        hist = hist.groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct("slice", "n", "lo", "hi"))).alias("h"))
        both = with_group(brackets, hist, [*keys, "i"], "left", few)
        first = _fold(F.col("h"), F.floor("place") - F.col("below"), lambda x: x["lo"], "double")
        last = _fold(F.col("h"), F.ceil("place") - F.col("below"), lambda x: x["hi"], "double")
        both = both.withColumns({"first": F.coalesce(first, F.col("a")), "last": F.coalesce(last, F.col("b"))})

        def total(keep):
            return F.aggregate(F.filter("h", keep), F.lit(0).cast("long"), lambda s, x: s + x["n"])

        brackets = cut_lineage(both.select(
            *keys, "i", "place", F.col("first").alias("a"), F.col("last").alias("b"),
            F.when(F.col("h").isNull(), F.col("below")).otherwise(F.col("below") + total(lambda x: x["hi"] < F.col("first"))).alias("below"),
            F.when(F.col("h").isNull(), F.col("inside")).otherwise(
                total(lambda x: (x["lo"] >= F.col("first")) & (x["hi"] <= F.col("last")))).alias("inside")))

    # distinct values with counts: equal values never fill a task
    values = inside(brackets).groupBy(*keys, "i", "__v").agg(F.count(F.lit(1)).alias("n"))
    lists = values.groupBy(*keys, "i").agg(F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), "n"))).alias("h"))
    found = brackets.join(lists.withColumnsRenamed({k: f"__l{k}" for k in (*keys, "i")}), reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__l{k}")) for k in (*keys, "i")]))
    lo = _fold(F.col("h"), F.floor("place") - F.col("below"), lambda x: x["v"], "double")
    hi = _fold(F.col("h"), F.ceil("place") - F.col("below"), lambda x: x["v"], "double")
    found = found.select(*keys, "i", lo.alias("lo"), hi.alias("hi"), (F.col("place") - F.floor("place")).alias("part"))
    found = found.select(*keys, "i", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in targets])
    out = with_group(stats.select(*keys, "n", "min", "mean", "max"), wide, keys, few=few)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "min", "mean", "max", *[f"q{i}" for i in targets])


DIGITS = 3  # hex digits of the hash that one histogram tells apart


def cutoffs(keyed: DataFrame, by: Sequence[str], wanted: Column) -> DataFrame:
    """``by..., n, last``: for each class the struct (hash, id) of the last of its ``wanted`` rows in the order of (hash, id).

    ``keyed`` has the columns of ``by``, ``hash`` (hex digits, evenly spread) and ``id``; ``wanted`` is a
    column over ``n`` (rows of the class) and the other columns of ``keyed``, the same in a class.
    A class of which nothing is wanted has a null ``last``. Rows that share an id fall on the same side.
    """
    extra = [c for c in keyed.columns if c not in (*by, "hash", "id")]
    groups = [*by, *extra]
    keyed = cut_lineage(keyed)

    def step(rows: DataFrame, length: int) -> DataFrame:
        digits = rows.groupBy(*groups, F.substring("hash", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        return digits.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("prefix", "n"))).alias("h"))

    def total(array, keep=None):
        return F.aggregate(F.filter(array, keep) if keep else F.col(array), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    length = DIGITS
    first = step(keyed, length).withColumn("n", total("h"))
    state = first.withColumn("rank", F.least(wanted.cast("long"), F.col("n")) - 1)
    while True:
        prefix = F.when(F.col("rank") >= 0, _fold(F.col("h"), F.col("rank"), lambda x: x["prefix"], "string"))
        state = state.withColumn("prefix", prefix)
        state = state.withColumns({"rank": F.col("rank") - total("h", lambda x: x["prefix"] < F.col("prefix")),
                                   "many": total("h", lambda x: x["prefix"] == F.col("prefix"))})
        state = cut_lineage(state.drop("h"))
        size = state.agg(F.count(F.lit(1)).alias("groups"), F.max("many").alias("many")).first()
        few = size["groups"] <= FEW_GROUPS
        if length >= 30 or (size["many"] or 0) <= INSIDE:
            break
        length += DIGITS
        at = with_group(keyed, state.select(*by, "prefix").where("prefix is not null"), list(by), few=few).where(F.startswith("hash", "prefix"))
        state = with_group(state.drop("prefix", "many"), step(at.drop("prefix"), length).drop(*extra), list(by), "left", few)
    at = with_group(keyed, state.select(*by, "prefix", "rank").where("prefix is not null"), list(by), few=few).where(F.startswith("hash", "prefix"))
    last = at.groupBy(*by).agg(F.try_element_at(F.sort_array(F.collect_list(F.struct("hash", "id"))), (F.first("rank") + 1).cast("int")).alias("last"))
    return cut_lineage(with_group(state.select(*by, "n"), last, list(by), "left", few))
