"""Feature / model queries (ML6-ML10, ML12-ML16, SET8, AG24, AG25)."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import linear as LN
from ..operators import merge as M
from ..operators import models as ML
from ..operators import sample as S
from ..operators import target_stats as TS
from ..session import cut_lineage, ensure_checkpoint_dir
from .common import LABELLED_SQL, T, labelled_docs, norm, norm_sql, r6
from .q_aggregate import eval_frame
from .registry import query


def _split(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return S.hash_split(d, 0.3, "doc_id", 11)


SPLIT_SQL = """sp AS (SELECT doc_id, lang, source, n_chars,
  CASE WHEN CAST(('0x' || substr(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3
       THEN 'test' ELSE 'train' END AS split FROM documents)"""


@query("one_hot_align", f"""WITH {SPLIT_SQL},
lv AS (SELECT list_sort(list(DISTINCT lang)) AS levels FROM sp WHERE split = 'train' AND lang <> 'es'),
ix AS (SELECT doc_id, coalesce(nullif(list_position(levels, lang), 0), len(levels) + 1) - 1 AS idx, len(levels) AS k
       FROM sp, lv WHERE split = 'test')
SELECT doc_id, idx, array_to_string(list_transform(range(0, k + 1), lambda i: CASE WHEN i = idx THEN 1 ELSE 0 END), ',') AS hot
FROM ix""")
def one_hot_align(spark, sf):
    """ML6 + ML7: one-hot levels fitted on training rows (Spanish never seen),
    applied to test rows; unseen values take the extra keep slot."""
    s = _split(spark, sf)
    enc = ML.fit_encoder(s.where((F.col("split") == "train") & (F.col("lang") != "es")), ["lang"])
    out = ML.align(s.where(F.col("split") == "test"), enc, ["lang"])
    hot = F.array_join(F.transform(vector_to_array("lang_vec"), lambda x: x.cast("int").cast("string")), ",")
    return out.select("doc_id", F.col("lang_idx").cast("bigint").alias("idx"), hot.alias("hot"))


def _tree_frame(spark, sf):
    e = eval_frame(spark, sf)
    return e.select("doc_id", "lang", "source", F.col("a_cf").cast("double").alias("label"), "conf",
                    F.col("p_cf").cast("double").alias("kw"))


@query("gbt_score")
def gbt_score(spark, sf):
    """ML8 + ML10: boosted trees on confidence + keyword + one-hot features,
    2-fold grid search on F1, batch scoring of every labelled row."""
    d = _tree_frame(spark, sf)
    enc = ML.fit_encoder(d, ["lang", "source"])
    x = VectorAssembler(inputCols=["conf", "kw", "lang_vec", "source_vec"], outputCol="features") \
        .transform(ML.align(d, enc, ["lang", "source"]))
    model = ML.train_gbt(x, "label", grid={"maxDepth": [2, 3], "maxIter": [10]}, folds=2, parallelism=4)
    return ML.predict(x, model, "Crisis finance", keep=["doc_id"])


def _categorical_frame(spark, sf):
    """Labelled documents with a column of many levels (the first line) beside two of few."""
    e = eval_frame(spark, sf).select("doc_id", "source", "lang", "a_cf", "a_paf", "a_aa", "conf", "p_cf")
    first = T(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    return e.join(first, "doc_id").select("doc_id", "lang", "source", F.md5("line").alias("line"), F.col("a_cf").cast("double").alias("label"),
                                          F.col("a_paf").cast("double").alias("paf"), F.col("a_aa").cast("double").alias("aa"), "conf",
                                          F.col("p_cf").cast("double").alias("kw"))


def _ts_sql(col):
    return (f"round((coalesce(sum(y) OVER w_{col}, 0) + prior) / (count(*) OVER w_{col} + 1), 6) AS {col}_ts")


@query("target_stats", f"""WITH e AS (SELECT d.doc_id, d.lang, d.source, md5(string_split(d.text, chr(10))[1]) AS line, CAST(l.quality AS DOUBLE) AS y
  FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT *, (SELECT avg(y) FROM e) AS prior FROM e)
SELECT doc_id, {', '.join(_ts_sql(c) for c in ('lang', 'source', 'line'))} FROM p
WINDOW {', '.join(f"w_{c} AS (PARTITION BY {c} ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                  for c in ('lang', 'source', 'line'))}""")
def target_stats(spark, sf):
    """ML9: ordered target statistics of three categories (4, 20 and thousands of levels)."""
    d = _categorical_frame(spark, sf)
    out = TS.ordered_target_stats(d, ["lang", "source", "line"], "label", "doc_id", TS.prior_of(d, "label"))
    return out.select(F.col("id").alias("doc_id"), *[r6(F.col(f"{c}_ts")).alias(f"{c}_ts") for c in ("lang", "source", "line")])


@query("gbt_categorical")
def gbt_categorical(spark, sf):
    """ML9: trees on raw categoricals with a 50/50 train/validation split; every labelled row scored by the model read back."""
    d = _categorical_frame(spark, sf)
    model, _ = TS.train_categorical_trees(d, "label", ["conf", "kw"], ["lang", "source", "line"], "doc_id", {"maxDepth": [2, 3], "maxIter": [10]})
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.save(path)
    return ML.predict(d, TS.CategoricalTrees.load(spark, path), "Crisis finance", keep=["doc_id"])


HALF_SQL = "CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.5"


@query("trees_by_label", f"""WITH t AS (SELECT quality, toxic FROM documents JOIN labels USING (doc_id) WHERE {HALF_SQL})
SELECT 'Crisis finance' AS label, count(*) AS n, count(*) FILTER (quality = 1) AS positives FROM t
UNION ALL SELECT 'PAF', count(*), count(*) FILTER (toxic = 1) FROM t
UNION ALL SELECT 'AA', count(*), count(*) FILTER (quality = 1 AND toxic = 1) FROM t""")
def trees_by_label(spark, sf):
    """ML8-ML10 + AG8: trees for three labels, each with the confidences of the labels before it as features, trained on one half and
    counted on the other: rows and positives of the confusion matrix."""
    d, out, num = _categorical_frame(spark, sf), None, ["conf", "kw"]
    for label, y in (("Crisis finance", "label"), ("PAF", "paf"), ("AA", "aa")):
        model, held = TS.train_categorical_trees(d, y, num, ["lang", "source"], "doc_id", {"maxDepth": [2], "maxIter": [5]})
        c = A.confusion(held, F.col(y) == 1, F.col("prediction") == 1)
        c = c.select(F.lit(label).alias("label"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), (F.col("fn") + F.col("tp")).alias("positives"))
        out = c if out is None else out.unionByName(c)
        d = cut_lineage(ML.predict(d, model, label, keep=d.columns).drop(f"{label} predicted"))
        num = [*num, f"{label} confidence"]
    return out


LASSO_NUM, LASSO_CAT = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_linenumber"]


def _lasso(spark, sf):
    """A target with a product of two figures, one level and noise (the price) in it, on figures and factors of lines."""
    li = T(spark, sf, "lineitem").withColumns({
        "id": F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]),
        "y": F.col("l_quantity") * (1 - F.col("l_discount")) * 100 + F.when(F.col("l_returnflag") == "R", -40).otherwise(0) + F.col("l_extendedprice") / 5000})
    return li, LN.fit_lasso(li, "y", LASSO_NUM, LASSO_CAT, "id", folds=10)


@query("lasso_coef")
def lasso_coef(spark, sf):
    """ML13: 10-fold cross-validated lasso over numbers and factors; nonzero coefficients by name (Column_level)."""
    return LN.lasso_coefficients(_lasso(spark, sf)[1], spark)


@query("lasso_optimality", """SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, true AS optimal
UNION ALL SELECT 'l_returnflag_' || l_returnflag, true FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus_' || l_linestatus, true FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'l_linenumber_' || CAST(l_linenumber AS VARCHAR), true FROM lineitem GROUP BY l_linenumber""")
def lasso_optimality(spark, sf):
    """ML13: every column of the fitted lasso meets the optimality conditions, checked on the rows' residuals."""
    li, fit = _lasso(spark, sf)
    return LN.lasso_optimality(li, fit, "y", LASSO_NUM, LASSO_CAT)


GLM_SQL = """WITH b AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_extendedprice AS x, l_returnflag AS f FROM lineitem),
c AS (SELECT y - avg(y) OVER (PARTITION BY f) AS yc, x - avg(x) OVER (PARTITION BY f) AS xc, y - avg(y) OVER () AS y0 FROM b),
s AS (SELECT sum(xc * yc) / sum(xc * xc) AS slope, count(*) AS n FROM c),
d AS (SELECT (SELECT slope FROM s) AS slope, sum((yc - slope * xc) ** 2) AS deviance, sum(y0 ** 2) AS null_deviance, any_value(n) AS n FROM c, s)
"""


@query("glm_factors", GLM_SQL + """SELECT n, round(slope, 6) AS slope, round(sqrt(deviance / n), 4) AS residual, round(sqrt(null_deviance / n), 4) AS spread,
  round(1 - deviance / null_deviance, 6) AS pseudo_r2, 'flag_group_R' AS aliased FROM d""")
def glm_factors(spark, sf):
    """ML12 + AG25: revenue on price and the return flag, with a second factor that the flag determines (aliased): root mean
    deviances of fit and mean, and pseudo R2."""
    li = T(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.col("l_extendedprice").alias("x"),
                                         F.col("l_returnflag").alias("flag"), F.when(F.col("l_returnflag") == "R", "R").otherwise("A").alias("flag_group"))
    fit = LN.fit_linear(li, "y", ["x"], ["flag", "flag_group"])
    aliased = ",".join(k for k, v in fit.coefficients.items() if v is None)
    return spark.createDataFrame([(fit.rows, round(fit.coefficients["x"], 6), round((fit.deviance / fit.rows) ** 0.5, 4),
                                   round((fit.null_deviance / fit.rows) ** 0.5, 4), round(fit.pseudo_r2, 6), aliased)],
                                 "n long, slope double, residual double, spread double, pseudo_r2 double, aliased string")


@query("glm_residuals", GLM_SQL + """, m AS (SELECT f, avg(y) AS my, avg(x) AS mx, count(*) AS n, sum(y) AS sy, sum(x) AS sx FROM b GROUP BY f)
SELECT f AS flag, n, round(my, 4) AS fitted_mean FROM m""")
def glm_residuals(spark, sf):
    """ML12: mean fitted value of each level (a least squares fit with a factor meets each level's mean), from the rows."""
    li = T(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.col("l_extendedprice").alias("x"),
                                         F.col("l_returnflag").alias("flag"))
    fit = LN.fit_linear(li, "y", ["x"], ["flag"])
    return li.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(LN.linear_predictor(fit.coefficients, ["x"], ["flag"])), 4).alias("fitted_mean"))


@query("text_classifier")
def text_classifier(spark, sf):
    """ML14: weighted TF-IDF logistic models per label (train split), scored on test."""
    d = labelled_docs(spark, sf).withColumns({"cf": (F.col("quality") == 1).cast("double"),
                                              "paf": (F.col("toxic") == 1).cast("double")})
    d = S.hash_split(d, 0.3, "doc_id", 13)
    tr = d.where(F.col("split") == "train")
    pos = tr.agg(*[F.avg(c).alias(c) for c in ("cf", "paf")]).first()
    weights = {c: (1 - pos[c]) / pos[c] if pos[c] else 1.0 for c in ("cf", "paf")}
    models = ML.train_text(tr, "text", ["cf", "paf"], weights, num_features=1 << 16, max_iter=20)
    te = d.where(F.col("split") == "test").select("doc_id", "text", "cf", "paf")
    out = te.select("doc_id")
    for lab, m in models.items():
        p = m.transform(te).select("doc_id", vector_to_array("probability")[1].alias(f"{lab}_confidence"))
        out = out.join(p, "doc_id")
    return out


@query("ols_r2", """SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def ols_r2(spark, sf):
    """ML12 + AG25: Gaussian GLM, pseudo R2 = 1 - deviance / null deviance."""
    li = T(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    return spark.createDataFrame([(round(LN.fit_linear(li, "l_extendedprice", ["l_quantity"]).pseudo_r2, 6),)], "r2 double")


TFIDF_SQL = """tok AS (SELECT doc_id, lang, unnest(list_filter(string_split(t, ' '), lambda w: length(w) >= 2)) AS term
                FROM (SELECT doc_id, lang, {norm} AS t FROM documents)),
dfr AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
tf AS (SELECT lang, term, count(*) AS tf FROM tok GROUP BY ALL),
w AS (SELECT lang, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS tfidf FROM tf JOIN dfr USING (term)),
s AS (SELECT lang, term, tfidf, tfidf / sqrt(sum(tfidf * tfidf) OVER (PARTITION BY lang)) AS score FROM w)""".replace(
    "{norm}", norm_sql("text"))


@query("tfidf_top_terms", f"""WITH {TFIDF_SQL}
SELECT lang, term, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tfidf DESC, term) AS rank FROM s) WHERE rank <= 20""")
def tfidf_top_terms(spark, sf):
    """ML15 + AG24 + ST5: corpus-fitted TF-IDF of each language's
    concatenated documents; top 20 terms."""
    d = T(spark, sf, "documents").select("doc_id", "lang", norm(F.col("text")).alias("t"))
    top = ML.tfidf_top(d, "t", "lang", 20)
    return top.select("lang", "term", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _group_expr():
    lab = F.col("labels")
    return (F.when(lab.contains("Unrelated"), F.lit(0))
            .when(lab.contains("AA"), F.lit(3))
            .when(lab.contains("PAF"), F.lit(2))
            .when(lab.contains("Crisis financing"), F.lit(1)))


@query("exclusive_terms", f"""WITH {LABELLED_SQL},
g AS (SELECT doc_id, {norm_sql('text')} AS t, CASE WHEN contains(labels, 'Unrelated') THEN 0 WHEN contains(labels, 'AA') THEN 3
  WHEN contains(labels, 'PAF') THEN 2 WHEN contains(labels, 'Crisis financing') THEN 1 END AS priority FROM ld),
tok AS (SELECT doc_id, priority, unnest(list_filter(string_split(t, ' '), lambda w: length(w) >= 2)) AS term FROM g),
dfr AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
tf AS (SELECT priority, term, count(*) AS tf FROM tok GROUP BY ALL),
w AS (SELECT priority, term, tf * (ln((1 + (SELECT count(*) FROM g)) / (1 + df)) + 1) AS tfidf FROM tf JOIN dfr USING (term)),
top AS (SELECT priority, term FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY tfidf DESC, term) AS rk FROM w)
        WHERE rk <= 50)
SELECT priority, term FROM top t WHERE priority = (SELECT min(priority) FROM top t2 WHERE t2.term = t.term)""")
def exclusive_terms(spark, sf):
    """SET8 over ML15: each label group's top-50 terms minus the terms of
    every group before it (unrelated < CF < PAF < AA)."""
    d = labelled_docs(spark, sf).select("doc_id", norm(F.col("text")).alias("t"), _group_expr().alias("priority"))
    top = ML.tfidf_top(d, "t", "priority", 50)
    return M.exclusive_terms(top.select("priority", "term"), "term", "priority")


@query("l2_normalise", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first
FROM embeddings""")
def l2_normalise(spark, sf):
    """ML16: L2 norm and the normalised vector (first component shown)."""
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", r6(ML.l2_norm("embedding")).alias("l2"),
                    r6(ML.l2_normalise("embedding")[0]).alias("first"))


@query("cosine", """
WITH pe AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings),
c AS (SELECT label, list(v ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM pe GROUP BY ALL) GROUP BY label)
SELECT e.vec_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), c.centroid), 6) AS cos
FROM embeddings e JOIN c USING (label)""")
def cosine(spark, sf):
    """ML16: cosine similarity of each vector to its label centroid (no pairs)."""
    e = T(spark, sf, "embeddings")
    c = ML.centroids(e, "embedding", "label")
    return e.join(F.broadcast(c), "label").select("vec_id", r6(ML.cosine("embedding", "centroid")).alias("cos"))


@query("nearest_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS id, d.vec_id AS neighbour, list_cosine_similarity(q.e, d.e) AS cos FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT id, neighbour, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, neighbour) AS rank FROM p) WHERE rank <= 10""")
def nearest_vectors(spark, sf):
    """ML16: the ten nearest of all vectors for every vector whose id is divisible by 50."""
    e = T(spark, sf, "embeddings")
    out = ML.nearest_vectors(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return out.select("id", "neighbour", r6(F.col("cos")).alias("cos"), F.col("rank").cast("long").alias("rank"))
