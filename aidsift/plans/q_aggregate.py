"""Aggregation and metric queries (AG1-AG14, AG17-AG23, FLT6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import project as P
from ..operators import rules as R
from .common import LABELLED_SQL, T, labelled_docs, norm, norm_sql, r6
from .q_rules import NKW, _kw_sql
from .registry import query

LABELS3 = {"Crisis finance": ("a_cf", "p_cf"), "PAF": ("a_paf", "p_paf"), "AA": ("a_aa", "p_aa")}


def eval_frame(spark, sf):
    """Labelled documents with actual labels, keyword predictions and a
    confidence stand-in (scored-table shape)."""
    d = T(spark, sf, "documents").select("doc_id", norm("text").alias("text"), "n_chars", "lang", "source")
    d = R.keyword_match(d, "text", NKW).drop("text").join(T(spark, sf, "labels"), "doc_id")  # flags cross the join, texts do not
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return d.select("doc_id", "lang", "source", q.alias("a_cf"), t.alias("a_paf"), (q & t).alias("a_aa"),
                    F.col("Crisis finance keyword match").alias("p_cf"),
                    F.col("PAF keyword match").alias("p_paf"), F.col("AA keyword match").alias("p_aa"),
                    (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("conf"))


EVAL_SQL = f"""ev0 AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, {norm_sql('d.text')} AS text
  FROM documents d JOIN labels l USING (doc_id)),
ev AS (SELECT doc_id, lang, source, quality = 1 AS a_cf, toxic = 1 AS a_paf, quality = 1 AND toxic = 1 AS a_aa,
  {_kw_sql(NKW).replace(' AS kw_cf', ' AS p_cf').replace(' AS kw_paf', ' AS p_paf').replace(' AS kw_aa', ' AS p_aa')},
  n_chars / (n_chars + 2000.0) AS conf FROM ev0)"""


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, sf):
    """AG1."""
    return A.value_counts(T(spark, sf, "documents"), "lang")


@query("describe", """
WITH d AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'lang' AS "column", count(*) AS n, count(*) FILTER (WHERE lang IS NULL) AS missing, count(DISTINCT lang) AS "distinct" FROM d
UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL), count(DISTINCT source) FROM d
UNION ALL SELECT 'quality', count(*), count(*) FILTER (WHERE quality IS NULL), count(DISTINCT quality) FROM d""")
def describe(spark, sf):
    """AG2: n / missing / distinct per column in one pass."""
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    return A.describe_col(d, ["lang", "source", "quality"])


LINES_SQL = """l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents),
top AS (SELECT 'line' AS "column", md5(value) AS value, count(*) AS n, (SELECT count(*) FROM l) AS total FROM l GROUP BY l.value ORDER BY n DESC, l.value LIMIT 10),
c AS (SELECT 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value, count(*) AS n, (SELECT count(*) FROM orders) AS total FROM orders
      GROUP BY o_custkey ORDER BY n DESC, CAST(o_custkey AS VARCHAR) LIMIT 10)"""


@query("describe_frequencies", f"""WITH {LINES_SQL}
SELECT "column", value, n, round(n / total, 6) AS share FROM (SELECT * FROM top UNION ALL SELECT * FROM c)""")
def describe_frequencies(spark, sf):
    """AG2: the ten most frequent lines of documents (hashed for the report) and customers of orders, counted exactly."""
    lines = T(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    cust = T(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("value"))
    tops = [A.top_values(lines, "value", 10).select(F.lit("line").alias("column"), F.md5("value").alias("value"), "n", "share"),
            A.top_values(cust, "value", 10).select(F.lit("o_custkey").alias("column"), "value", "n", "share")]
    return tops[0].unionByName(tops[1]).withColumn("share", r6(F.col("share")))


@query("prevalence", """
SELECT round(avg(CASE WHEN coalesce(l.quality = 1, false) THEN 1.0 ELSE 0.0 END), 6) AS prevalence,
       round(avg(CASE WHEN l.quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def prevalence(spark, sf):
    """AG3: share of a boolean and share not NULL."""
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    return d.agg(r6(A.share(F.col("quality") == 1)).alias("prevalence"),
                 r6(A.coverage("quality")).alias("coverage"))


@query("funnel", f"""WITH {EVAL_SQL}
SELECT lang, round(count(*) FILTER (WHERE a_cf) / count(*), 6) AS rate_1,
  round(count(*) FILTER (WHERE a_cf AND a_paf) / nullif(count(*) FILTER (WHERE a_cf), 0), 6) AS rate_2,
  round(count(*) FILTER (WHERE a_cf AND a_paf AND a_aa) / nullif(count(*) FILTER (WHERE a_cf AND a_paf), 0), 6) AS rate_3
FROM ev GROUP BY lang""")
def funnel(spark, sf):
    """AG4: nested rates CF -> PAF within CF -> AA within PAF."""
    f = A.funnel(eval_frame(spark, sf), ["a_cf", "a_paf", "a_aa"], ["lang"])
    return f.select("lang", *[r6(F.col(c)).alias(c) for c in ("rate_1", "rate_2", "rate_3")])


QS = "[0.05, 0.1, 0.5, 0.9, 0.95]"


def _qsum_sql(src, col, by):
    return (f"SELECT {by}, round(min({col}), 6) AS min, round(q[1], 6) AS p5, round(q[2], 6) AS p10, "
            f"round(mean, 6) AS mean, round(q[3], 6) AS median, round(q[4], 6) AS p90, round(q[5], 6) AS p95, "
            f"round(max({col}), 6) AS max FROM (SELECT {by}, min({col}) AS min_, quantile_cont({col}, {QS}) AS q, "
            f"avg({col}) AS mean, min({col}) AS {col}_min, max({col}) AS {col}_max FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {by}) t")


def _round_summary(df, by):
    return df.select(*by, *[r6(F.col(c)).alias(c) for c in ("min", "p5", "p10", "mean", "median", "p90", "p95", "max")])


@query("quantile_summary", """
SELECT l_returnflag, round(min(l_extendedprice), 6) AS min, round(q[1], 6) AS p5, round(q[2], 6) AS p10,
  round(avg(l_extendedprice), 6) AS mean, round(q[3], 6) AS median, round(q[4], 6) AS p90, round(q[5], 6) AS p95,
  round(max(l_extendedprice), 6) AS max
FROM (SELECT *, quantile_cont(l_extendedprice, [0.05, 0.1, 0.5, 0.9, 0.95]) OVER (PARTITION BY l_returnflag) AS q
      FROM lineitem WHERE l_extendedprice IS NOT NULL) t
GROUP BY l_returnflag, q""")
def quantile_summary(spark, sf):
    """AG5: type-7 quantiles per group."""
    return _round_summary(A.quantile_summary(T(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]),
                          ["l_returnflag"])


@query("outcome_quantiles", f"""WITH {EVAL_SQL},
lg AS (SELECT 'Crisis finance' AS label, a_cf AS actual, p_cf AS predicted, conf FROM ev
  UNION ALL SELECT 'PAF', a_paf, p_paf, conf FROM ev UNION ALL SELECT 'AA', a_aa, p_aa, conf FROM ev),
oc AS (SELECT label, conf, 'actual true' AS outcome FROM lg WHERE actual
  UNION ALL SELECT label, conf, 'false positive' FROM lg WHERE NOT actual AND predicted
  UNION ALL SELECT label, conf, 'false negative' FROM lg WHERE actual AND NOT predicted)
SELECT label, outcome, round(min(conf), 6) AS min, round(q[1], 6) AS p5, round(q[2], 6) AS p10,
  round(avg(conf), 6) AS mean, round(q[3], 6) AS median, round(q[4], 6) AS p90, round(q[5], 6) AS p95,
  round(max(conf), 6) AS max
FROM (SELECT *, quantile_cont(conf, [0.05, 0.1, 0.5, 0.9, 0.95]) OVER (PARTITION BY label, outcome) AS q FROM oc) t
GROUP BY label, outcome, q""")
def outcome_quantiles(spark, sf):
    """AG6: confidence quantiles by label x outcome slice."""
    labs = {n: (a, p, "conf") for n, (a, p) in LABELS3.items()}
    return _round_summary(A.outcome_summary(eval_frame(spark, sf), labs), ["label", "outcome"])


@query("histogram", """
SELECT l_returnflag, CAST(CASE WHEN l_extendedprice < 0.0 THEN 0 WHEN l_extendedprice >= 100000.0 THEN 21
  ELSE floor((l_extendedprice - 0.0) / 100000.0 * 20) + 1 END AS INTEGER) AS bucket, count(*) AS n
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL""")
def histogram(spark, sf):
    """AG7: equal-width histogram."""
    return A.histogram(T(spark, sf, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20, ["l_returnflag"])


@query("confusion", f"""WITH {EVAL_SQL}
SELECT lang, count(*) FILTER (WHERE NOT a_cf AND NOT p_cf) AS tn, count(*) FILTER (WHERE NOT a_cf AND p_cf) AS fp,
  count(*) FILTER (WHERE a_cf AND NOT p_cf) AS fn, count(*) FILTER (WHERE a_cf AND p_cf) AS tp FROM ev GROUP BY lang""")
def confusion(spark, sf):
    """AG8: zero-filled binary confusion matrix per language."""
    return A.confusion(eval_frame(spark, sf), "a_cf", "p_cf", ["lang"])


CM3_SQL = """cm AS (
  SELECT 'Crisis finance' AS label, count(*) FILTER (WHERE NOT a_cf AND NOT p_cf) AS tn, count(*) FILTER (WHERE NOT a_cf AND p_cf) AS fp,
    count(*) FILTER (WHERE a_cf AND NOT p_cf) AS fn, count(*) FILTER (WHERE a_cf AND p_cf) AS tp FROM ev
  UNION ALL SELECT 'PAF', count(*) FILTER (WHERE NOT a_paf AND NOT p_paf), count(*) FILTER (WHERE NOT a_paf AND p_paf),
    count(*) FILTER (WHERE a_paf AND NOT p_paf), count(*) FILTER (WHERE a_paf AND p_paf) FROM ev
  UNION ALL SELECT 'AA', count(*) FILTER (WHERE NOT a_aa AND NOT p_aa), count(*) FILTER (WHERE NOT a_aa AND p_aa),
    count(*) FILTER (WHERE a_aa AND NOT p_aa), count(*) FILTER (WHERE a_aa AND p_aa) FROM ev)"""


@query("confusion_multilabel", f"WITH {EVAL_SQL}, {CM3_SQL} SELECT * FROM cm")
def confusion_multilabel(spark, sf):
    """AG9: one confusion row per label, one pass."""
    return A.confusion_multilabel(eval_frame(spark, sf), LABELS3)


METRICS_SQL = """SELECT *, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * (coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0))
    / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) AS f1"""


def _round_metrics(df):
    return df.select(*[c for c in df.columns if c not in ("accuracy", "precision", "recall", "f1")],
                     *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("metrics", f"WITH {EVAL_SQL}, {CM3_SQL} {METRICS_SQL} FROM cm")
def metrics(spark, sf):
    """AG10: accuracy, precision, recall, F1 per label."""
    return _round_metrics(A.metrics(A.confusion_multilabel(eval_frame(spark, sf), LABELS3)))


@query("metrics_micro", f"""WITH {EVAL_SQL}, {CM3_SQL}, s AS (SELECT sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM cm)
{METRICS_SQL.replace('SELECT *,', 'SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,')} FROM s""")
def metrics_micro(spark, sf):
    """AG11: micro-averaged metrics over all label slots of multi-hot arrays."""
    e = eval_frame(spark, sf)
    e = e.select(F.array(*[F.col(a).cast("double") for a, _ in LABELS3.values()]).alias("actual"),
                 F.array(*[F.col(p).cast("double") for _, p in LABELS3.values()]).alias("pred"))
    m = A.metrics_micro(e, "actual", "pred")
    return _round_metrics(m.select(*[F.col(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")],
                                   "accuracy", "precision", "recall", "f1"))


@query("exact_match", f"""WITH {EVAL_SQL}
SELECT round(avg(CASE WHEN a_cf = p_cf AND a_paf = p_paf AND a_aa = p_aa THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
  count(*) AS n FROM ev""")
def exact_match(spark, sf):
    """AG12: all labels right at once."""
    m = A.exact_match(eval_frame(spark, sf), list(LABELS3.values()))
    return m.select(r6(F.col("exact_match")).alias("exact_match"), "n")


@query("class_weights", f"""WITH {EVAL_SQL}
SELECT 'Crisis finance' AS label, round(count(*) FILTER (WHERE NOT a_cf) / nullif(count(*) FILTER (WHERE a_cf), 0), 6) AS weight FROM ev
UNION ALL SELECT 'PAF', round(count(*) FILTER (WHERE NOT a_paf) / nullif(count(*) FILTER (WHERE a_paf), 0), 6) FROM ev
UNION ALL SELECT 'AA', round(count(*) FILTER (WHERE NOT a_aa) / nullif(count(*) FILTER (WHERE a_aa), 0), 6) FROM ev""")
def class_weights(spark, sf):
    """AG13: negatives / positives per label."""
    w = A.class_weights(eval_frame(spark, sf), {n: a for n, (a, _) in LABELS3.items()})
    return w.select("label", r6(F.col("weight")).alias("weight"))


@query("class_weights_total", f"""WITH {LABELLED_SQL}
SELECT labels AS class, round((SELECT count(*) FROM ld) / count(*), 6) AS weight FROM ld GROUP BY labels""")
def class_weights_total(spark, sf):
    """AG14: total / class count for a single-label column."""
    w = A.class_weights(labelled_docs(spark, sf), {"labels": "labels"}, kind="total_class")
    return w.select("class", r6(F.col("weight")).alias("weight"))


@query("dup_table", """
SELECT md5(text) AS text_key, count(*) - 1 AS extra FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_table(spark, sf):
    """AG17: duplicated texts and their extra occurrences."""
    d = T(spark, sf, "documents").select(F.md5("text").alias("text_key"))
    return A.duplicate_counts(d, "text_key")


@query("overlap_count", """
SELECT CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS overlap FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def overlap_count(spark, sf):
    """AG18: duplicates in the union of two tables."""
    o = T(spark, sf, "orders")
    return A.overlap_count(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_totalprice") > 300000),
                           ["o_custkey"])


@query("label_prevalence", f"""WITH {LABELLED_SQL}, e AS (SELECT unnest(list_distinct(string_split(labels, ','))) AS label FROM ld)
SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ld), 2) AS pct FROM e GROUP BY label""")
def label_prevalence(spark, sf):
    """AG19: count and percent of rows carrying each label."""
    return A.label_prevalence(labelled_docs(spark, sf), "labels")


@query("length_share", """
SELECT lang, round(avg(CASE WHEN len(string_split(text, ' ')) > 300 THEN 1.0 ELSE 0.0 END), 6) AS share_long,
  max(len(string_split(text, ' '))) AS max_tokens FROM documents GROUP BY lang""")
def length_share(spark, sf):
    """AG20: share of texts longer than 300 blank-separated tokens."""
    s = A.length_share(T(spark, sf, "documents"), "text", 300, ["lang"])
    return s.select("lang", r6(F.col("share_long")).alias("share_long"), F.col("max_tokens").cast("bigint").alias("max_tokens"))


@query("miss_rate", f"""WITH {EVAL_SQL},
known AS (SELECT DISTINCT doc_id FROM ev WHERE a_cf AND doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')),
missed AS (SELECT doc_id FROM known EXCEPT SELECT doc_id FROM ev WHERE p_cf)
SELECT (SELECT count(*) FROM missed) AS missed, (SELECT count(*) FROM known) AS known,
  round(coalesce((SELECT count(*) FROM missed) / nullif((SELECT count(*) FROM known), 0), 0), 6) AS miss_rate""")
def miss_rate(spark, sf):
    """AG21: missed known keys / known keys present in the register."""
    e = eval_frame(spark, sf)
    reg = T(spark, sf, "documents").where(F.col("lang") != "de")
    m = A.miss_rate(e.where("a_cf"), e.where("p_cf"), reg, "doc_id")
    return m.select("missed", "known", r6(F.col("miss_rate")).alias("miss_rate"))


@query("row_sum", """
SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_tax <> 0 THEN l_tax END, 0) + coalesce(l_discount, 0), 6) AS s
FROM lineitem WHERE coalesce(CASE WHEN l_tax <> 0 THEN l_tax END, 0) + coalesce(l_discount, 0) > 0""")
def row_sum(spark, sf):
    """AG22 + FLT6: NULL-ignoring row sum; drop zero rows."""
    li = T(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    li = P.drop_zero(li, ["tax", "l_discount"])
    return li.select("l_orderkey", "l_linenumber", r6(P.row_sum(["tax", "l_discount"])).alias("s"))


@query("token_estimate", """
SELECT CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS tokens,
  round(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) * 2.0 / 1000.0 * 0.5, 6) AS cost FROM documents""")
def token_estimate(spark, sf):
    """AG23: corpus tokens and job cost estimate."""
    c = A.token_cost(T(spark, sf, "documents"), ["text"], 2.0, 0.5)
    return c.select(F.col("tokens").cast("bigint").alias("tokens"), r6(F.col("cost")).alias("cost"))
