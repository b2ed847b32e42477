"""Reports from the plain operators (PRJ1, PRJ4, PRJ6, ST1-ST4, WN3, SET4, SC10-SC14, SC22, SC31, AG4, AG20, AG24, AG25, RL6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregate as A
from ..operators import enrich as E
from ..operators import linear as LN
from ..operators import link as K
from ..operators import merge as M
from ..operators import project as P
from ..operators import sample as S
from .common import T, norm, norm_sql, r6
from .q_aggregate import EVAL_SQL, eval_frame
from .q_enrich import AUTO_SQL, _auto
from .q_models import GLM_SQL
from .q_rules import PROP_SQL, prop_frame
from .registry import query


@query("report_columns", """SELECT c_custkey AS CustKey, c_mktsegment AS Segment, c_acctbal AS Balance FROM customer
WHERE c_acctbal IS NOT NULL ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 25""")
def report_columns(spark, sf):
    """PRJ1, PRJ4, PRJ6, ST1, ST3: names without blanks, columns kept and dropped, the first rows of a mixed order."""
    c = T(spark, sf, "customer").where("c_acctbal is not null").select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_mktsegment").alias("Segment"), F.col("c_acctbal").alias("Balance "), "c_name", "c_nationkey")
    c = P.keep(P.drop_cols(P.strip_name_spaces(c), ["c_name"]), ["CustKey", "Segment", "Balance"])
    return S.sort_by(c, [("Segment", "asc"), ("Balance", "desc"), ("CustKey", "asc")]).limit(25)


@query("review_queue", PROP_SQL + """
SELECT doc_id, cf_determination FROM fin ORDER BY CASE cf_determination WHEN 'Review' THEN 1 WHEN 'Yes' THEN 2 ELSE 4 END, doc_id DESC LIMIT 60""")
def review_queue(spark, sf):
    """ST2: the first of a queue that puts Review before Yes, unlisted values last, newest first."""
    det = prop_frame(spark, sf).select("doc_id", F.col("Crisis finance determination").alias("cf_determination"))
    return S.sort_rank(det, "cf_determination", ["Review", "Yes", "Missing"], [("doc_id", "desc")]).limit(60)


@query("first_lines", """SELECT l_orderkey, arg_min(l_partkey, l_linenumber) AS l_partkey, arg_min(l_quantity, l_linenumber) AS l_quantity
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) GROUP BY l_orderkey""")
def first_lines(spark, sf):
    """WN3: the first line of each order (lines of one number by part and supplier)."""
    li = T(spark, sf, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return K.first_match(li, "l_orderkey", "place", ["l_partkey", "l_quantity"])


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 40")
def head_rows(spark, sf):
    """ST4: the first rows in an explicit order."""
    return S.head_n(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 40, "o_orderkey")


@query("unique_values", "SELECT DISTINCT source FROM documents")
def unique_values(spark, sf):
    """SET4."""
    return M.unique_values(T(spark, sf, "documents"), "source")


@query("text_tests", f"""WITH d AS (SELECT doc_id, text, {norm_sql('text')} AS t, n_chars, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, regexp_matches(t, '\\b(of|der|les)\\b') AS whole_word, regexp_matches(text, '(?i)TION.{{0,3}} ') AS pattern, contains(lower(text), 'the ') AS contains_the,
  len(list_filter(l, lambda x: regexp_matches(x, '\\S'))) AS lines, TRY_CAST(substr(CAST(1990 + doc_id % 40 AS VARCHAR) || '-05', 1, 4) AS INTEGER) AS year,
  n_chars / 1000.0 > 0.5 AS above, n_chars / 1000.0 >= 0.5 AS at_least FROM d""")
def text_tests(spark, sf):
    """SC10-SC14 + SC22: whole words, patterns, containment, non-blank lines, the year of a date text, thresholds."""
    d = T(spark, sf, "documents")
    date = F.concat((F.lit(1990) + F.col("doc_id") % 40).cast("string"), F.lit("-05"))
    return d.select("doc_id", X.matches(norm("text"), X.word_pattern(["of", "der", "les"]), ignore_case=False).alias("whole_word"),
                    X.matches("text", "TION.{0,3} ").alias("pattern"), X.contains_ci("text", "THE ").alias("contains_the"),
                    F.size(X.split_nonblank("text")).cast("long").alias("lines"), X.year_prefix(date).alias("year"),
                    N.threshold(F.col("n_chars") / 1000.0).alias("above"), N.threshold(F.col("n_chars") / 1000.0, inclusive=True).alias("at_least"))


@query("round_even_percent", """SELECT o_orderkey, round_even(o_totalprice / 8, 1) AS eighth,
  CAST(CAST(round(100 * (o_totalprice / (SELECT max(o_totalprice) FROM orders)), 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM orders""")
def round_even_percent(spark, sf):
    """SC31: half-even rounding (exact decimals) and a share as a percentage."""
    o = T(spark, sf, "orders")
    top = o.agg(F.max("o_totalprice").alias("m")).scalar()
    return o.select("o_orderkey", F.bround(F.col("o_totalprice") / 8, 1).alias("eighth"),
                    F.concat(F.round(100 * (F.col("o_totalprice") / top), 0).cast("long").cast("string"), F.lit("%")).alias("share"))


@query("token_histogram", """WITH t AS (SELECT len(string_split(text, ' ')) AS n FROM documents)
SELECT CAST(CASE WHEN n >= 2048 THEN 33 ELSE floor(n / 64.0) + 1 END AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1""")
def token_histogram(spark, sf):
    """AG20 + AG7: documents by token count, in 32 buckets up to 2,048 and one above."""
    return A.histogram(T(spark, sf, "documents").select(F.size(F.split("text", " ")).alias("n")), "n", 0, 2048, 32)


@query("group_terms", f"""WITH t AS (SELECT lang, unnest(string_split({norm_sql('text')}, ' ')) AS term FROM documents)
SELECT lang, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL""")
def group_terms(spark, sf):
    """AG24: term counts of each language's texts laid end to end."""
    d = T(spark, sf, "documents").select("lang", norm("text").alias("t"))
    return A.group_term_counts(d, "lang", "t")


@query("fitted_pseudo_r2", GLM_SQL + "SELECT round(1 - deviance / null_deviance, 6) AS pseudo_r2 FROM d")
def fitted_pseudo_r2(spark, sf):
    """AG25 on rows: the fit's residuals against the mean's."""
    li = T(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.col("l_extendedprice").alias("x"),
                                         F.col("l_returnflag").alias("flag"))
    fit = LN.fit_linear(li, "y", ["x"], ["flag"])
    out = A.pseudo_r2(li.withColumn("fitted", LN.linear_predictor(fit.coefficients, ["x"], ["flag"])), "y", "fitted")
    return out.select(r6(F.col("r2")).alias("pseudo_r2"))


@query("funnel_stages", f"""WITH {EVAL_SQL}
SELECT lang, round(count(*) FILTER (a_cf) / count(*), 6) AS rate_1, round(count(*) FILTER (a_cf AND p_paf) / nullif(count(*) FILTER (a_cf), 0), 6) AS rate_2,
  round(count(*) FILTER (a_cf AND p_paf AND p_cf) / nullif(count(*) FILTER (a_cf AND p_paf), 0), 6) AS rate_3 FROM ev GROUP BY lang""")
def funnel_stages(spark, sf):
    """AG4 with three flags of their own: labelled, then two keyword families."""
    f = A.funnel(eval_frame(spark, sf), ["a_cf", "p_paf", "p_cf"], ["lang"])
    return f.select("lang", *[r6(F.col(f"rate_{i}")).alias(f"rate_{i}") for i in (1, 2, 3)])


@query("version_rate", f"""WITH {AUTO_SQL},
known AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM auto)),
missed AS (SELECT doc_id FROM known EXCEPT SELECT doc_id FROM auto WHERE kw_cf)
SELECT (SELECT count(*) FROM missed) AS missed, (SELECT count(*) FROM known) AS known,
  round((SELECT count(*) FROM missed) / (SELECT count(*) FROM known), 6) AS miss_rate""")
def version_rate(spark, sf):
    """RL6: how much of the manual list the automatic run missed."""
    auto = _auto(spark, sf).select(F.col("doc_id").alias("key"), "Crisis finance keyword match")
    manual = T(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return E.version_compare(manual, auto, "key", F.col("Crisis finance keyword match"))[2].withColumn("miss_rate", r6(F.col("miss_rate")))
