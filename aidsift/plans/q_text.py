"""Scalar text / label functions and projections (SC1-SC20, SC31, FLT1-FLT5,
PRJ1-PRJ8, PRJ12-PRJ14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import project as P
from .common import LABEL_VOCAB, LABELLED_SQL, T, labelled_docs, norm, norm_sql
from .registry import query


@query("norm_text", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def norm_text(spark, sf):
    """SC1-SC3, SC8 on whole documents (engine-neutral ASCII form)."""
    return T(spark, sf, "documents").select("doc_id", norm(F.col("text")).alias("norm"))


def _strip_zero_sql(c):
    return (f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN "
            f"CASE WHEN ltrim({c}, '0') = '' THEN '0' ELSE ltrim({c}, '0') END ELSE {c} END")


def _norm_key_sql(c):
    x = f"regexp_replace(trim({c}), '^\\s+|\\s+$', '', 'g')"
    x = _strip_zero_sql(x)
    x = f"regexp_replace(lower(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')), '\\pP', ' ', 'g')"
    return f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"


@query("norm_key", f"""
SELECT p_partkey, {_norm_key_sql('p_brand')} AS k_brand,
       {_norm_key_sql("lpad(CAST(p_size AS VARCHAR), 4, '0')")} AS k_size,
       {_norm_key_sql("p_name || '.' || p_type")} AS k_name
FROM part""")
def norm_key(spark, sf):
    """SC5-SC7: project-number key normaliser on part attributes."""
    p = T(spark, sf, "part")
    return p.select("p_partkey", X.norm_key("p_brand").alias("k_brand"),
                    X.norm_key(F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("k_size"),
                    X.norm_key(F.concat(F.col("p_name"), F.lit("."), F.col("p_type"))).alias("k_name"))


@query("label_filters", f"""WITH {LABELLED_SQL}
SELECT doc_id, labels FROM ld
WHERE contains(labels, 'Crisis financing') AND NOT contains(labels, 'AA') AND lang IN ('en', 'de')""")
def label_filters(spark, sf):
    """FLT1 + FLT5: label-substring predicates and a membership filter."""
    d = labelled_docs(spark, sf)
    d = d.where(L.has_label("labels", "Crisis financing", "AA"))
    return P.where_in(d, "lang", ["en", "de"]).select("doc_id", "labels")


@query("length_filters", """
SELECT doc_id, length(text) AS n_len FROM documents
WHERE text IS NOT NULL AND length(text) > 1000 AND starts_with(source, 'src1') AND NOT ends_with(source, '5')""")
def length_filters(spark, sf):
    """FLT3 + SC12 + SC15."""
    d = P.min_length(T(spark, sf, "documents"), "text", 1000)
    d = d.where(F.startswith("source", F.lit("src1")) & ~F.endswith("source", F.lit("5")))
    return d.select("doc_id", F.length("text").alias("n_len"))


@query("year_filter", """
SELECT o_orderkey, year(o_orderdate) AS yr FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND year(o_orderdate) IN (1996, 1998, 1999)""")
def year_filter(spark, sf):
    """FLT4: year range and set."""
    o = T(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return P.year_in(o, "yr", 1996, 1999, [1996, 1998, 1999], date_col="o_orderdate").select("o_orderkey", "yr")


@query("literal_replace", """
SELECT doc_id, replace(replace(text, '"', '""'), 'the', '_nan') AS t FROM documents""")
def literal_replace(spark, sf):
    """SC16: literal replaces (double the quotes; a literal token swap)."""
    d = T(spark, sf, "documents")
    return d.select("doc_id", X.replace_literal(X.replace_literal("text", '"', '""'), "the", "_nan").alias("t"))


@query("text_prefix", "SELECT doc_id, left(text, 100) AS head FROM documents")
def text_prefix(spark, sf):
    """SC17: the first 100 characters (the operator itself is a prefix)."""
    return T(spark, sf, "documents").select("doc_id", X.prefix("text", 100).alias("head"))


@query("round_percent", """
WITH t AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(100.0 * n / sum(n) OVER (), 3) AS pct,
       round(abs(s / 7.0), 2) AS s7
FROM t""")
def round_percent(spark, sf):
    """SC31: abs, round and percent of total."""
    li = T(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"))
    tot = li.select(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    return g.select(
        "l_returnflag", F.round(100.0 * F.col("n") / tot, 3).alias("pct"),
        F.round(F.abs(F.col("s") / 7.0), 2).alias("s7"))


@query("concat_skip_null", """
SELECT conv_id, turn, concat_ws(' | ', role, CASE WHEN turn > 0 THEN text END) AS joined FROM conversations""")
def concat_skip_null(spark, sf):
    """SC9: separator join that skips NULLs."""
    c = T(spark, sf, "conversations")
    return c.select("conv_id", "turn",
                    X.join_text(["role", F.when(F.col("turn") > 0, F.col("text"))], " | ").alias("joined"))


@query("strip_non_ascii", """
SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS ascii_text FROM documents""")
def strip_non_ascii(spark, sf):
    """SC5."""
    return T(spark, sf, "documents").select("doc_id", X.to_ascii("text").alias("ascii_text"))


@query("lead_zero", f"""
SELECT c_custkey, {_strip_zero_sql('substr(c_name, 10)')} AS k_id,
       {_strip_zero_sql("'00' || CAST(c_custkey AS VARCHAR)")} AS k_key
FROM customer""")
def lead_zero(spark, sf):
    """SC6: leading zeros dropped from numeric ids; exact digits kept."""
    c = T(spark, sf, "customer")
    return c.select("c_custkey", X.strip_lead_zero(F.substring("c_name", 10, 1 << 20)).alias("k_id"),
                    X.strip_lead_zero(F.concat(F.lit("00"), F.col("c_custkey").cast("string"))).alias("k_key"))


@query("rename_select_suffix", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       l_extendedprice AS "price ML", l_discount AS "discount ML", 'v1' AS "model version"
FROM lineitem WHERE l_quantity > 45""")
def rename_select_suffix(spark, sf):
    """PRJ1-PRJ8: keep-first-n, rename map, suffix selection, constant column."""
    li = T(spark, sf, "lineitem").where(F.col("l_quantity") > 45)
    li = P.rename(li, {"l_extendedprice": "price ML", "l_discount": "discount ML", "l_tax": "tax ML x"})
    ml = P.cols_ending(li, " ML")
    out = P.keep_first(li, 4, [F.col(f"`{c}`") for c in ml])
    out = P.with_const(out, "model version", "v1")
    return out.select(*[F.col(f"`{c}`") for c in P.common_cols(out, out)])


@query("label_recode", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Direct' WHEN 'MACHINERY' THEN 'Indirect'
  WHEN 'AUTOMOBILE' THEN 'Both' WHEN 'FURNITURE' THEN 'Part PAF' END AS paf_type,
  CASE WHEN contains(c_mktsegment, 'HOLD') OR contains(c_mktsegment, 'BUILD') THEN 1 ELSE 0 END AS is_pos
FROM customer""")
def label_recode(spark, sf):
    """PRJ12 + PRJ13: code recode through a map and a binary collapse."""
    c = T(spark, sf, "customer")
    m = {"BUILDING": "Direct", "MACHINERY": "Indirect", "AUTOMOBILE": "Both", "FURNITURE": "Part PAF"}
    return c.select("c_custkey", L.recode("c_mktsegment", m).alias("paf_type"),
                    L.binarise("c_mktsegment", ["HOLD", "BUILD"]).alias("is_pos"))


@query("label_drop_parent", f"""WITH {LABELLED_SQL}
SELECT doc_id, CASE WHEN len(string_split(labels, ',')) > 1
  THEN array_to_string(list_filter(string_split(labels, ','), lambda x: x <> 'Crisis financing'), ',')
  ELSE labels END AS labels2 FROM ld""")
def label_drop_parent(spark, sf):
    """PRJ14: drop the parent label when a finer one is present."""
    return labelled_docs(spark, sf).select("doc_id", L.drop_parent("labels", "Crisis financing").alias("labels2"))


@query("multi_hot", f"""WITH {LABELLED_SQL}
SELECT doc_id,
  CAST(list_contains(string_split(labels, ','), 'Crisis financing') AS INT) AS hot_cf,
  CAST(list_contains(string_split(labels, ','), 'PAF') AS INT) AS hot_paf,
  CAST(list_contains(string_split(labels, ','), 'AA') AS INT) AS hot_aa,
  CASE WHEN list_position(['Crisis financing', 'PAF', 'AA'], string_split(labels, ',')[1]) > 0
       THEN list_position(['Crisis financing', 'PAF', 'AA'], string_split(labels, ',')[1]) - 1 END AS first_id
FROM ld""")
def multi_hot(spark, sf):
    """SC19 + SC20: multi-hot vector over the label vocabulary; label ids."""
    d = labelled_docs(spark, sf).withColumn("arr", L.label_array("labels"))
    mh = L.multi_hot("arr", LABEL_VOCAB)
    return d.select("doc_id", *[mh[i].cast("int").alias(n) for i, n in enumerate(["hot_cf", "hot_paf", "hot_aa"])],
                    L.label_id(F.col("arr")[0], LABEL_VOCAB).alias("first_id"))
