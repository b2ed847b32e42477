"""Join, set and assertion queries (JN1-JN10, JN19, SET1-SET7, AST1-AST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from .common import T
from .registry import query

# keys with NULLs: order status 'P' and market segment HOUSEHOLD become NULL
_SEG_SQL = ("CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'MACHINERY' THEN 'O' "
            "WHEN 'AUTOMOBILE' THEN 'X' ELSE NULL END")


def _seg_key():
    s = F.col("c_mktsegment")
    return (F.when(s == "BUILDING", "F").when(s == "MACHINERY", "O")
            .when(s == "AUTOMOBILE", "X"))


def _orders_side(spark, sf):
    o = T(spark, sf, "orders").withColumn(
        "st", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.groupBy(F.col("o_custkey").alias("cust"), "st").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _cust_side(spark, sf):
    c = T(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("cust"), _seg_key().alias("st"), "c_nationkey")


ORD_SIDE_SQL = """a AS (SELECT o_custkey AS cust, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS st,
  count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)"""
CUST_SIDE_SQL = f"b AS (SELECT c_custkey AS cust, {_SEG_SQL} AS st, c_nationkey FROM customer)"


@query("full_outer_nullsafe", f"""WITH {ORD_SIDE_SQL}, {CUST_SIDE_SQL}
SELECT coalesce(a.cust, b.cust) AS cust, coalesce(a.st, b.st) AS st, n_orders, total, c_nationkey
FROM a FULL JOIN b ON a.cust IS NOT DISTINCT FROM b.cust AND a.st IS NOT DISTINCT FROM b.st""")
def full_outer_nullsafe(spark, sf):
    """JN2: full outer merge on two keys where NULL matches NULL."""
    return M.full_merge(_orders_side(spark, sf), _cust_side(spark, sf), ["cust", "st"])


@query("merge_coalesce_checked", """
WITH a AS (SELECT c_custkey AS cust, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS seg,
                  CASE WHEN c_acctbal > 0 THEN c_nationkey END AS nation FROM customer),
     b AS (SELECT c_custkey AS cust, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS seg,
                  CASE WHEN c_acctbal > 9000 THEN c_nationkey + 1 WHEN c_acctbal < 5000 THEN c_nationkey END AS nation
           FROM customer WHERE c_acctbal > -500)
SELECT coalesce(a.cust, b.cust) AS cust, coalesce(a.seg, b.seg) AS seg,
       coalesce(a.nation, b.nation) AS nation,
       coalesce(a.nation <> b.nation, false) AS conflict
FROM a FULL JOIN b ON a.cust IS NOT DISTINCT FROM b.cust AND a.seg IS NOT DISTINCT FROM b.seg""")
def merge_coalesce_checked(spark, sf):
    """JN3: coalescing merge with a conflict flag where both sides disagree."""
    c = T(spark, sf, "customer")
    seg = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment"))
    a = c.select(F.col("c_custkey").alias("cust"), seg.alias("seg"),
                 F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("nation"))
    b = c.where(F.col("c_acctbal") > -500).select(
        F.col("c_custkey").alias("cust"), seg.alias("seg"),
        F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey") + 1)
         .when(F.col("c_acctbal") < 5000, F.col("c_nationkey")).alias("nation"))
    merged, _ = M.merge_coalesce(a, b, ["cust", "seg"], ["nation"])
    return merged


@query("text_feature_join", """
SELECT d.doc_id, r.source AS f_source, r.lang AS f_lang
FROM documents d LEFT JOIN (SELECT DISTINCT text, source, lang FROM documents WHERE n_chars > 500) r USING (text)""")
def text_feature_join(spark, sf):
    """JN1: attach features by the whole text (exact copies fan out)."""
    d = T(spark, sf, "documents")
    feats = d.where(F.col("n_chars") > 500).select("text", F.col("source").alias("f_source"),
                                                   F.col("lang").alias("f_lang"))
    return M.attach_features(d.select("doc_id", "text"), feats, "text").drop("text")


@query("dim_default_zero", """
SELECT c_custkey, coalesce(f.fragile, 0) AS fragile, coalesce(f.sids, 0) AS sids
FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, 1 AS fragile,
   CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS sids FROM nation WHERE n_regionkey IN (1, 3)) f USING (c_nationkey)""")
def dim_default_zero(spark, sf):
    """JN4: left join to a small dimension, unmatched -> 0."""
    n = T(spark, sf, "nation").where(F.col("n_regionkey").isin(1, 3)).select(
        F.col("n_nationkey").alias("c_nationkey"), F.lit(1).alias("fragile"),
        F.when(F.col("n_regionkey") == 1, 1).otherwise(0).alias("sids"))
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return M.dim_join(c, n, "c_nationkey", {"fragile": 0, "sids": 0}).select("c_custkey", "fragile", "sids")


@query("composite_left", """
WITH dim AS (SELECT o_custkey, year(o_orderdate) AS yr, count(*) AS n_year FROM orders
             WHERE year(o_orderdate) >= 1997 GROUP BY ALL)
SELECT o.o_orderkey, d.n_year FROM orders o
LEFT JOIN dim d ON o.o_custkey = d.o_custkey AND year(o.o_orderdate) = d.yr""")
def composite_left(spark, sf):
    """JN5: left join on a composite (key, year) key."""
    o = T(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    dim = o.where(F.col("yr") >= 1997).groupBy("o_custkey", "yr").agg(F.count(F.lit(1)).alias("n_year"))
    return o.join(dim, ["o_custkey", "yr"], "left").select("o_orderkey", "n_year")


@query("natural_join", """
SELECT c.c_custkey, c.c_nationkey, n.n_name, n.n_regionkey
FROM customer c LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2) n
  ON c.c_nationkey IS NOT DISTINCT FROM n.c_nationkey""")
def natural_join(spark, sf):
    """JN6: join on all shared column names (left form)."""
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation").where(F.col("n_regionkey") != 2).withColumnRenamed("n_nationkey", "c_nationkey")
    return M.natural_join(c, n, "left")


@query("right_join", """
SELECT l.doc_id, d.source, l.quality FROM
  (SELECT doc_id, source FROM documents WHERE lang = 'en') d RIGHT JOIN labels l USING (doc_id)""")
def right_join(spark, sf):
    """JN7: every reviewed row kept."""
    d = T(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id", "source")
    l = T(spark, sf, "labels").select("doc_id", "quality")
    return M.reviewed_join(d, l, "doc_id")


@query("semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi(spark, sf):
    """JN8."""
    o = T(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return M.semi(T(spark, sf, "customer"), o, "c_custkey", "o_custkey").select("c_custkey")


@query("anti", """SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_custkey IS NOT DISTINCT FROM c.c_custkey)""")
def anti(spark, sf):
    """JN9: null-safe anti join."""
    o = T(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return M.anti(T(spark, sf, "customer"), o, "c_custkey", "o_custkey").select("c_custkey")


@query("semi_or", """SELECT c_custkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_acctbal > 9000""")
def semi_or(spark, sf):
    """JN10: key in the other table OR a constant predicate."""
    o = T(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    c = T(spark, sf, "customer")
    return M.semi_or(c, o, "c_custkey", F.col("c_acctbal") > 9000).select("c_custkey")


@query("override_patch", """
SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN b.text ELSE d.text END AS text
FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""")
def override_patch(spark, sf):
    """JN19: keyed override of the join text."""
    d = T(spark, sf, "documents").select("doc_id", "text")
    o = T(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return M.patch(d, o, "doc_id", ["text"])


@query("union_all", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderstatus = 'O'""")
def union_all(spark, sf):
    """SET1: union by name, missing columns NULL."""
    o = T(spark, sf, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_totalprice", "o_orderstatus", "o_orderkey")
    b = o.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderstatus")
    return M.union_all(a, b)


@query("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct(spark, sf):
    """SET2."""
    return M.distinct(T(spark, sf, "customer").select("c_nationkey", "c_mktsegment"))


@query("except", """SELECT c_nationkey FROM customer WHERE c_acctbal > 0
EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000""")
def except_(spark, sf):
    """SET3: distinct set difference, NULL keys dropped."""
    c = T(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    s = T(spark, sf, "supplier").where(F.col("s_acctbal") > 2000)
    return M.except_keys(c, s, "c_nationkey", "s_nationkey")


@query("intersect", """SELECT DISTINCT c_nationkey FROM customer
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def intersect(spark, sf):
    """SET4 + SET5: distinct known keys that occur in the register."""
    s = T(spark, sf, "supplier").where(F.col("s_acctbal") > 5000)
    return M.known_keys(T(spark, sf, "customer"), s, "c_nationkey", "s_nationkey")


@query("set_partition", """
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500),
     b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 6000)
SELECT coalesce(a.k, b.k) AS k,
       CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'A only' ELSE 'B only' END AS side
FROM a FULL JOIN b ON a.k = b.k""")
def set_partition(spark, sf):
    """SET6: A only / B only / both."""
    a = T(spark, sf, "customer").where(F.col("c_acctbal") > 9500).select(F.col("c_nationkey").alias("k"))
    b = T(spark, sf, "supplier").where(F.col("s_acctbal") > 6000).select(F.col("s_nationkey").alias("k"))
    return M.set_partition(a, b, ["k"])


@query("unrelated", """
SELECT DISTINCT doc_id, source FROM (
  SELECT doc_id, source FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')) u
WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents d USING (doc_id)
                  WHERE l.quality = 1 AND d.doc_id = u.doc_id AND d.source = u.source)""")
def unrelated(spark, sf):
    """SET7: (C u H) minus related, null-safe."""
    d = T(spark, sf, "documents")
    c = d.where(F.col("lang") == "en")
    h = d.where(F.col("source").isin("src1", "src2"))
    rel = d.join(T(spark, sf, "labels").where(F.col("quality") == 1), "doc_id", "left_semi")
    return M.unrelated([c, h], rel, ["doc_id", "source"])


@query("assert_report", """
SELECT 'no negative price' AS "check", count(*) AS violations FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'unique customer', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orders have customers', count(*) FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def assert_report(spark, sf):
    """AST1 + AST2: violation counts, zero when the invariant holds."""
    o, c, li = T(spark, sf, "orders"), T(spark, sf, "customer"), T(spark, sf, "lineitem")
    return M.assert_report([
        M.expect_empty("no negative price", o.where(F.col("o_totalprice") < 0)),
        M.expect_unique("unique customer", c, "c_custkey"),
        M.expect_unique("unique line", li, ["l_orderkey", "l_linenumber"]),
        M.expect_empty("orders have customers", M.anti(o, c, "o_custkey", "c_custkey")),
    ])
