"""Features and models on Spark ML (ML6-ML10, ML12-ML16).

Trees, linear models and the text classifier are Spark ML estimators
(distributed training); one-hot levels live in a fitted
``StringIndexerModel`` so scoring aligns to the training levels by
construction (unseen and missing values land in the extra "keep" slot).
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (HashingTF, IDF, OneHotEncoder, RegexTokenizer, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sample import top_n


def one_hot(cols: Sequence[str], missing: bool = True) -> list:
    """ML6: StringIndexer (alphabetical levels; ``keep`` adds a slot for
    missing/unseen values) + OneHotEncoder (sparse vectors, no dropped level)."""
    inv = "keep" if missing else "error"
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid=inv, stringOrderType="alphabetAsc")
           for c in cols]
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                        dropLast=False, handleInvalid="error")
    return idx + [enc]


def fit_encoder(train: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """Fit ML6 on the training rows; apply the model to align (ML7)."""
    # NULL cannot be indexed: treat it as the missing level explicitly
    return Pipeline(stages=one_hot(cols)).fit(train.fillna("__missing__", list(cols)))


def align(df: DataFrame, fitted: PipelineModel, cols: Sequence[str]) -> DataFrame:
    """ML7: encode new rows with the training levels: unseen -> keep slot,
    levels absent from the new rows -> 0, extra values never add columns."""
    return fitted.transform(df.fillna("__missing__", list(cols)))


def f1_evaluator(label: str = "label") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)


def train_gbt(df: DataFrame, label: str, features: str = "features",
              grid: Mapping[str, Sequence] | None = None, folds: int = 2,
              parallelism: int = 4, seed: int = 42):
    """ML8: boosted trees with k-fold grid search on positive-class F1, refit
    on all rows. grid keys: maxDepth, subsamplingRate,
    featureSubsetStrategy, minInfoGain, maxIter, stepSize."""
    gbt = GBTClassifier(labelCol=label, featuresCol=features, seed=seed)
    g = ParamGridBuilder()
    for k, vals in (grid or {"maxDepth": [3]}).items():
        g = g.addGrid(getattr(gbt, k), list(vals))
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=g.build(), evaluator=f1_evaluator(label),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(df).bestModel


def predict(df: DataFrame, model, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """ML10: batch scoring: predicted class and P(positive) columns."""
    out = model.transform(df)
    return out.select(*(keep or df.columns),
                      (F.col("prediction") == 1.0).alias(f"{name} predicted"),
                      vector_to_array(F.col("probability"))[1].alias(f"{name} confidence"))


def train_text(df: DataFrame, text: str, labels: Sequence[str], weights: Mapping[str, float] | None = None,
               num_features: int = 1 << 18, max_iter: int = 50) -> dict[str, PipelineModel]:
    """ML14: one weighted logistic model per label on hashed TF-IDF of the
    text. ``weights`` = positive-class weight per label (AG13)."""
    models = {}
    for lab in labels:
        w = (weights or {}).get(lab, 1.0)
        d = df.withColumn("__w", F.when(F.col(lab) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
        pipe = Pipeline(stages=[
            RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"\w\w+", gaps=False, toLowercase=True),
            HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
            IDF(inputCol="__tf", outputCol="features"),
            LogisticRegression(labelCol=lab, featuresCol="features", weightCol="__w", maxIter=max_iter)])
        models[lab] = pipe.fit(d)
    return models


def tfidf_weights(df: DataFrame, text: str, group: str, corpus: DataFrame | None = None,
                  id_col: str = "doc_id") -> DataFrame:
    """ML15 + AG24: TF-IDF fitted on the corpus, applied to each group's
    concatenated text: tf = term count in the group, idf =
    ln((1 + n) / (1 + df)) + 1. Tokens are the normalised text's words of 2+
    characters. Returns (group, tf, term, df, tfidf)."""
    corpus = corpus if corpus is not None else df
    toks = lambda d: F.filter(F.split(F.col(text), " "), lambda t: F.length(t) >= 2)
    n = corpus.select(F.count(F.lit(1))).scalar()
    dfreq = corpus.select(id_col, F.explode(F.array_distinct(toks(corpus))).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = df.select(group, F.explode(toks(df)).alias("term")).groupBy(group, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return tf.join(dfreq, "term").withColumn(
        "tfidf", F.col("tf") * (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1))


def tfidf_top(df: DataFrame, text: str, group: str, n: int = 1000, corpus: DataFrame | None = None,
              id_col: str = "doc_id") -> DataFrame:
    """ML15 + ST5: top ``n`` terms per group by weight, ties by term; ``score`` is
    the weight L2-normalised over the group's terms. The weights are written once;
    norms (a mergeable sum) meet the top rows alone, a NULL group like any other."""
    w = cut_lineage(tfidf_weights(df, text, group, corpus, id_col))
    norms = w.groupBy(F.col(group).alias("__g")).agg(F.sqrt(F.sum(F.col("tfidf") ** 2)).alias("__norm"))
    top = top_n(w, [group], "tfidf", n, "term")
    return top.join(norms, top[group].eqNullSafe(norms["__g"])).withColumn("score", F.col("tfidf") / F.col("__norm")).drop("__norm", "__g")


def l2_norm(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(c) -> Column:
    """ML16: row-wise L2 normalisation of an array column."""
    c = F.col(c) if isinstance(c, str) else c
    nrm = l2_norm(c)
    return F.transform(c, lambda x: x.cast("double") / nrm)


def cosine(a, b) -> Column:
    """ML16: cosine similarity of two equal-length array columns."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    return dot / (l2_norm(a) * l2_norm(b))


def centroids(df: DataFrame, vec: str, by: str) -> DataFrame:
    """Mean vector per group: element-wise averages (posexplode + group),
    reassembled in position order; size is bounded by groups x dimension."""
    e = df.select(by, F.posexplode(vec).alias("pos", "v"))
    m = e.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("__s")) \
        .select(by, F.transform("__s", lambda s: s["v"]).alias("centroid"))


QUERY_BLOCK = 4096


def nearest_vectors(df: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """ML16: for each query the ``k`` other vectors of ``df`` with the largest cosine (double precision), ties to the smaller
    id: ``id, neighbour, cos, rank``.

    Queries are taken in blocks of at most ``QUERY_BLOCK`` vectors, which bounds what a
    task holds of them. A task multiplies the block with its batches of vectors and
    keeps k a query as it goes, so no pair is written but its best, and the
    tasks' lists merge by a partial top-k. Ids are integers. Vectors that are null, zero, of another length or with
    null or non-finite parts have no neighbours and are none.
    """
    spark = df.sparkSession
    usable = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)

    def rows(frame):
        return frame.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))

    asked = rows(queries).select("id", "v", F.size("v").alias("d")).repartitionByRange(F.col("d"), F.col("id")).sortWithinPartitions("d", "id")
    asked = cut_lineage(asked.withColumn("place", F.monotonically_increasing_id())
                        .withColumn("block", F.struct("d", F.expr(f"place div {QUERY_BLOCK}").alias("b"))))
    blocks = [(r["block"]["d"], r["block"]["b"]) for r in asked.select("block").distinct().collect()]
    out = None
    for d, b in sorted(blocks):
        # at most QUERY_BLOCK rows
        block = asked.where((F.col("block.d") == d) & (F.col("block.b") == b)).select("id", "v").collect()
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in block], dtype=np.int64), _unit(np.array([r["v"] for r in block]))))
        part = rows(df).where(F.size("v") == d).mapInArrow(lambda batches, held=held: _best(batches, held.value, k), "id long, neighbour long, cos double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "id long, neighbour long, cos double, rank int")
    return top_n(out, ["id"], "cos", k, "neighbour")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(batches, held, k: int):
    """The k best of a task's vectors for each query."""
    ids, queries = held
    best_id, best = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            near = np.asarray(part.column(0), dtype=np.int64)
            vectors = part.column(1)
            cos = queries @ _unit(np.asarray(vectors.flatten()).reshape(len(vectors), -1)).T
            cos[ids[:, None] == near[None, :]] = -np.inf  # not itself
            best_id = np.concatenate([best_id, np.broadcast_to(near, cos.shape)], axis=1)
            best = np.concatenate([best, cos], axis=1)
            order = np.lexsort((best_id, -best), axis=1)[:, :k]
            best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
    found = best > -np.inf
    row = np.broadcast_to(ids[:, None], found.shape)
    yield pa.RecordBatch.from_arrays([pa.array(row[found]), pa.array(best_id[found]), pa.array(best[found])], names=["id", "neighbour", "cos"])
