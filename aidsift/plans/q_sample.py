"""Sampling, split, dedupe and ordering queries (WN1-WN9, ST1-ST6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as S
from .common import LABELLED_SQL, T, labelled_docs
from .q_aggregate import EVAL_SQL, eval_frame
from .registry import query


def _h(seed, col):
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


@query("dedupe_first", "SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(spark, sf):
    """WN1: first document per distinct text."""
    d = T(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return S.dedupe_first(d, "text_key", "doc_id")


@query("dup_flag", """SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicated FROM documents""")
def dup_flag(spark, sf):
    """WN2: second and later occurrences of a text."""
    d = T(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"))
    return S.dup_flag(d, "k", "doc_id").select("doc_id", "duplicated")


@query("stratified_split", f"""WITH {LABELLED_SQL},
r AS (SELECT doc_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {_h(42, 'doc_id')}, doc_id) AS rk,
             count(*) OVER (PARTITION BY labels) AS n FROM ld)
SELECT doc_id, labels, CASE WHEN rk <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    """WN4: exact per-class 20% test split, seed 42."""
    d = labelled_docs(spark, sf).select("doc_id", "labels")
    return S.stratified_split(d, "labels", 0.2, "doc_id", 42)


@query("hash_split", f"""SELECT doc_id,
  CASE WHEN CAST(('0x' || substr({_h(7, 'doc_id')}, 1, 8)) AS BIGINT) / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END AS split
FROM documents""")
def hash_split(spark, sf):
    """WN5: unstratified 25% seeded split."""
    return S.hash_split(T(spark, sf, "documents").select("doc_id"), 0.25, "doc_id", 7)


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {_h(1, 'doc_id')}, doc_id LIMIT 100")
def sample_n(spark, sf):
    """WN6 / WN9: seeded shuffle and take 100."""
    return S.sample_n(T(spark, sf, "documents").select("doc_id"), 100, "doc_id", 1)


@query("rebalance", f"""WITH {EVAL_SQL},
pos AS (SELECT doc_id, lang, a_cf FROM ev WHERE a_cf),
neg AS (SELECT doc_id, lang, a_cf, row_number() OVER (PARTITION BY lang ORDER BY {_h(3, 'doc_id')}, doc_id) AS rk FROM ev WHERE NOT a_cf),
np AS (SELECT lang, count(*) AS k FROM pos GROUP BY lang)
SELECT doc_id, lang, a_cf FROM pos
UNION ALL SELECT doc_id, lang, a_cf FROM neg JOIN np USING (lang) WHERE rk <= k""")
def rebalance(spark, sf):
    """WN7: all positives + as many seeded negatives, per language."""
    e = eval_frame(spark, sf).select("doc_id", "lang", "a_cf")
    return S.rebalance(e, "a_cf", "doc_id", 3, ["lang"], positive=True)


@query("halve_class", f"""WITH {LABELLED_SQL},
u AS (SELECT doc_id, labels, row_number() OVER (ORDER BY {_h(5, 'doc_id')}, doc_id) AS rk FROM ld WHERE labels = 'Unrelated')
SELECT doc_id, labels FROM ld WHERE labels <> 'Unrelated'
UNION ALL SELECT doc_id, labels FROM u WHERE rk <= floor((SELECT count(*) FROM u) / 2)""")
def halve_class(spark, sf):
    """WN8: keep a seeded half of the Unrelated class."""
    d = labelled_docs(spark, sf).select("doc_id", "labels")
    return S.halve_class(d, "labels", "Unrelated", "doc_id", 5)


@query("sort_multi", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, (o_totalprice > 300000) DESC,
  o_totalprice DESC, o_orderkey) AS pos FROM orders""")
def sort_multi(spark, sf):
    """ST1 + ST3: multi-key mixed-direction sort; ``pos`` is the exact
    position in the global order (distributed ranking)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                      (F.col("o_totalprice") > 300000).alias("big"))
    order = [F.col("o_orderstatus").asc_nulls_last(), F.col("big").desc_nulls_last(),
             F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]
    return S.ranked(o, order, name="pos").select("o_orderkey", "pos")


@query("sort_rank", f"""WITH {EVAL_SQL}
SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 5 END,
  conf DESC, doc_id) AS pos FROM ev""")
def sort_rank(spark, sf):
    """ST2: custom rank order (en < fr < de < other), then confidence desc."""
    e = eval_frame(spark, sf)
    order = [S.rank_expr("lang", ["en", "fr", "de"]),
             F.col("conf").desc_nulls_last(), F.col("doc_id")]
    return S.ranked(e, order, name="pos").select("doc_id", "pos")


@query("top_n", """SELECT lang, doc_id, n_chars, rank FROM (
  SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
WHERE rank <= 5""")
def top_n(spark, sf):
    """ST5: top 5 documents by length per language."""
    d = T(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return S.top_n(d, ["lang"], "n_chars", 5, "doc_id").select("lang", "doc_id", "n_chars",
                                                                F.col("rank").cast("bigint").alias("rank"))


@query("head_n", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def head_n(spark, sf):
    """ST4: first n rows in an explicit order."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return o.orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@query("class_sort", f"""WITH {EVAL_SQL}
SELECT doc_id, array_to_string(list_transform(list_reverse_sort(
  [struct_pack(conf := round(conf, 6), label := 'Crisis finance'), struct_pack(conf := round(1 - conf, 6), label := 'PAF'),
   struct_pack(conf := round(conf / 2, 6), label := 'AA')]), lambda x: x.label), ',') AS ranked_labels FROM ev""")
def class_sort(spark, sf):
    """ST6: a record's classes sorted by confidence desc."""
    e = eval_frame(spark, sf)
    confs = F.array(F.round(F.col("conf"), 6), F.round(1 - F.col("conf"), 6), F.round(F.col("conf") / 2, 6))
    labs = F.array(F.lit("Crisis finance"), F.lit("PAF"), F.lit("AA"))
    s = S.classes_sorted(confs, labs)
    return e.select("doc_id", F.array_join(F.transform(s, lambda x: x["label"]), ",").alias("ranked_labels"))
