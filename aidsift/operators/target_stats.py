"""Ordered target statistics: categories of any number of levels as one number each (ML9).

A training row's statistic of a level is the mean target of the level's rows before
it in a seeded order, drawn towards the overall mean, so no row sees its own
target. Rows are sorted by (column, level, seeded hash) over all partitions;
running sums inside a partition plus the sums of the level's earlier partitions
give the prefix, so a level with a third of all rows is spread like any other. New
rows take the statistic of all the level's training rows; an unseen level takes
the overall mean.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sample import hash_split, seeded_key
from .select import with_group

SUFFIX = "_ts"


def _long(df: DataFrame, cols: Sequence[str], *more) -> DataFrame:
    """A row per row and column; a missing value is a level."""
    level = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return df.select(*more, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), level(c).alias("level")) for c in cols])).alias("x")).select("*", "x.*").drop("x")


def _wide(long: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long.groupBy("id").agg(*[F.max(F.when(F.col("c") == c, F.col("ts"))).alias(f"{c}{SUFFIX}") for c in cols])


def prior_of(df: DataFrame, label: str) -> float:
    return df.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.0


def ordered_target_stats(df: DataFrame, cols: Sequence[str], label: str, id_col: str, prior: float, seed: int | str = 42,
                         weight: float = 1.0) -> DataFrame:
    """``id`` and ``<col>_ts`` of each training row. Ids are unique; labels are numbers without NULL."""
    rows = _long(df, cols, F.col(id_col).alias("id"), seeded_key(id_col, seed).alias("h"), F.col(label).cast("double").alias("y"))
    rows = rows.repartitionByRange("c", "level", "h", "id").sortWithinPartitions("c", "level", "h", "id")
    rows = cut_lineage(rows.withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("part", "c", "level").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.count("y").over(earlier), "s": F.coalesce(F.sum("y").over(earlier), F.lit(0.0))})
    sums = rows.groupBy("c", "level", "part").agg(F.count("y").alias("pn"), F.sum("y").alias("ps"))
    parts = Window.partitionBy("c", "level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"bn": F.sum("pn").over(parts), "bs": F.sum("ps").over(parts)}).where("bn is not null")
    # only the first level of a partition goes on from an earlier one: at most one row per partition
    offsets = F.broadcast(sums.select("c", "level", "part", "bn", "bs"))
    rows = rows.join(offsets, ["c", "level", "part"], "left")
    ts = (F.col("s") + F.coalesce("bs", F.lit(0.0)) + F.lit(weight * prior)) / (F.col("n") + F.coalesce("bn", F.lit(0)) + F.lit(weight))
    return _wide(rows.select("id", "c", ts.alias("ts")), cols)


def level_stats(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``c, level, n, s``: rows and target sum of each level of each column."""
    return _long(df, cols, F.col(label).cast("double").alias("y")).groupBy("c", "level").agg(F.count("y").alias("n"), F.sum("y").alias("s"))


def apply_target_stats(df: DataFrame, stats: DataFrame, cols: Sequence[str], id_col: str, prior: float, weight: float = 1.0) -> DataFrame:
    """``id`` and ``<col>_ts`` of new rows from the written ``level_stats`` of the training rows."""
    rows = with_group(_long(df, cols, F.col(id_col).alias("id")), stats, ["c", "level"], "left")
    ts = (F.coalesce("s", F.lit(0.0)) + F.lit(weight * prior)) / (F.coalesce("n", F.lit(0)) + F.lit(weight))
    return _wide(rows.select("id", "c", ts.alias("ts")), cols)


class CategoricalTrees:
    """ML9: boosted trees on numbers and target statistics, with bins that do not depend on the levels."""

    def __init__(self, trees: PipelineModel, stats: DataFrame, num: Sequence[str], cat: Sequence[str], id_col: str, prior: float):
        self.trees, self.stats, self.num, self.cat, self.id_col, self.prior = trees, stats, list(num), list(cat), id_col, prior

    def transform(self, df: DataFrame) -> DataFrame:
        ts = apply_target_stats(df, self.stats, self.cat, self.id_col, self.prior)
        return self.trees.transform(df.join(ts, df[self.id_col].eqNullSafe(ts["id"])).drop(ts["id"]))

    def save(self, path: str) -> None:
        from ..sources.files import save_model
        save_model(self.trees, f"{path}/trees")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        meta = [(self.num, self.cat, self.id_col, self.prior)]
        self.stats.sparkSession.createDataFrame(meta, "num array<string>, cat array<string>, id_col string, prior double").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CategoricalTrees":
        from ..sources.files import load_model
        m = spark.read.parquet(f"{path}/meta").first()
        return CategoricalTrees(load_model(f"{path}/trees"), spark.read.parquet(f"{path}/stats"), m["num"], m["cat"], m["id_col"], m["prior"])


def f1(scored: DataFrame, label: str) -> float:
    """F1 of the positive class (0 where nothing is right)."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    c = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")).first()
    return 2.0 * c["tp"] / max(2 * c["tp"] + c["fp"] + c["fn"], 1)


def _fit(rows: DataFrame, num: Sequence[str], cat: Sequence[str], label: str, params: Mapping, seed: int) -> PipelineModel:
    asm = VectorAssembler(inputCols=[*num, *[f"{c}{SUFFIX}" for c in cat]], outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, maxBins=32, **params).fit(asm.transform(rows))
    return PipelineModel([asm, trees])


def train_categorical_trees(df: DataFrame, label: str, num: Sequence[str], cat: Sequence[str], id_col: str,
                            grid: Mapping[str, Sequence] | None = None, test_size: float = 0.5, seed: int = 42) -> tuple[CategoricalTrees, DataFrame]:
    """The model with the best F1 on the held-out share, and that share scored by it (``df``'s columns, prediction, probability).

    Each point of the grid is trained on the other share's ordered statistics; the held-out rows take
    statistics of the training rows alone.
    """
    parts = hash_split(df, test_size, id_col, seed, "__split")
    train, test = (parts.where(F.col("__split") == s).drop("__split") for s in ("train", "test"))
    prior = prior_of(train, label)
    ts = ordered_target_stats(train, cat, label, id_col, prior, seed)
    rows = cut_lineage(train.join(ts, train[id_col].eqNullSafe(ts["id"])).drop("id" if id_col != "id" else ts["id"]))
    stats = cut_lineage(level_stats(train, cat, label))
    best = None
    points = grid or {"maxDepth": [3]}
    for values in product(*points.values()):
        model = CategoricalTrees(_fit(rows, num, cat, label, dict(zip(points, values)), seed), stats, num, cat, id_col, prior)
        scored = model.transform(test)
        score = f1(scored, label)
        if best is None or score > best[0]:
            best = (score, model, scored)
    return best[1], best[2]
