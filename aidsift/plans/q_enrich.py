"""Enrichment, review and version queries (SC25-SC29, RL5-RL8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import review as RV
from ..operators import rules as R
from ..session import ensure_checkpoint_dir
from .common import T, norm, norm_sql, padded_any_sql, r6
from .registry import query

YEARS = list(range(1995, 2002))


def _tx(spark, sf):
    """orders + customer as transactions: recipient = nation, USD millions."""
    o = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("c_nationkey").alias("iso"), F.year("o_orderdate").alias("year"),
                    "c_mktsegment", (F.col("o_totalprice") / 1e6).alias("usd_commitment"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 2e6).alias("usd_disbursement"))


TX_SQL = """tx AS (SELECT o_orderkey, c_nationkey AS iso, year(o_orderdate) AS year, c_mktsegment,
  o_totalprice / 1e6 AS usd_commitment, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2e6 END AS usd_disbursement
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
POP_SQL = f"""{TX_SQL},
cnt AS (SELECT iso, year, count(*) * 997 AS population FROM tx GROUP BY ALL),
pop AS (SELECT n.iso, y.year, CAST(c.population AS BIGINT) AS population
  FROM (SELECT DISTINCT iso FROM tx) n CROSS JOIN (SELECT unnest({YEARS}) AS year) y
  LEFT JOIN cnt c ON c.iso = n.iso AND c.year = y.year)"""


def _pop_long(spark, sf):
    tx = _tx(spark, sf)
    wide = tx.groupBy("iso").pivot("year", YEARS).agg((F.count(F.lit(1)) * 997).alias("p"))
    return E.unpivot_years(wide, ["iso"], [str(y) for y in YEARS])


@query("unpivot_years", f"WITH {POP_SQL} SELECT iso, year, population FROM pop")
def unpivot_years(spark, sf):
    """SC29: wide year table (a pivot of order counts) melted to (iso, year, value)."""
    return _pop_long(spark, sf).select("iso", "year", F.col("population").cast("bigint").alias("population"))


@query("per_capita", f"""WITH {POP_SQL}
SELECT o_orderkey, round(usd_commitment * 1e6 / population, 6) AS usd_commitment_per_capita,
  round(usd_disbursement * 1e6 / population, 6) AS usd_disbursement_per_capita
FROM tx LEFT JOIN pop USING (iso, year)""")
def per_capita(spark, sf):
    """JN5 + SC25: join population on (iso, year), amounts per head."""
    t = _tx(spark, sf).join(_pop_long(spark, sf), ["iso", "year"], "left")
    return t.select("o_orderkey", r6(E.per_capita("usd_commitment", "population")).alias("usd_commitment_per_capita"),
                    r6(E.per_capita("usd_disbursement", "population")).alias("usd_disbursement_per_capita"))


# stand-ins for the two pooled-fund keywords (the driver prose is invented)
SHARE_WORDS = [("only", E.SFERA_SHARE), ("thing", E.DREF_SHARE)]


def _share_case(word, shares):
    whens = " ".join(f"WHEN {y} THEN {v}" for y, v in shares.items())
    return f"CASE WHEN {padded_any_sql('t', [word])} THEN CASE year {whens} END END"


@query("imputed_share", f"""WITH d AS (SELECT doc_id, 2016 + doc_id % 8 AS year, {norm_sql('text')} AS t FROM documents)
SELECT doc_id, year, CAST(coalesce({_share_case(*SHARE_WORDS[1])}, {_share_case(*SHARE_WORDS[0])}, 1.0) AS DOUBLE) AS share,
  round(1000.0 * CAST(coalesce({_share_case(*SHARE_WORDS[1])}, {_share_case(*SHARE_WORDS[0])}, 1.0) AS DOUBLE), 6) AS imputed
FROM d""")
def imputed_share(spark, sf):
    """SC26 + SC27: imputed share by (keyword family, year), default 1; the
    second family overrides; amount x share."""
    d = T(spark, sf, "documents").select("doc_id", (F.lit(2016) + F.col("doc_id") % 8).alias("year"),
                                         norm(F.col("text")).alias("t"))
    d = d.withColumn("share", E.imputed_share("t", "year", SHARE_WORDS))
    d = E.imputed_amounts(d.withColumn("amt", F.lit(0.001)), ["amt"], "share")
    return d.select("doc_id", "year", "share", r6(F.col("paf_amt_imputed")).alias("imputed"))


@query("contingent_flag", f"""SELECT doc_id, CASE WHEN {padded_any_sql(norm_sql('text'), ['of the', 'attion'])}
  AND source IN ('src1', 'src3', 'src5') THEN 1 END AS contingent FROM documents""")
def contingent_flag(spark, sf):
    """SC28: keyword family AND lender in list -> 1 else NULL."""
    d = T(spark, sf, "documents")
    return d.select("doc_id", E.contingent_flag(norm(F.col("text")), F.col("source"), ["of the", "attion"],
                                                ["src1", "src3", "src5"]).alias("contingent"))


@query("enrich", f"""WITH {POP_SQL},
g AS (SELECT n_nationkey AS iso, n_regionkey AS wb_region FROM nation),
fr AS (SELECT n_nationkey AS iso, 1 AS fragile FROM nation WHERE n_regionkey = 3)
SELECT o_orderkey,
  CASE WHEN c_mktsegment IN ('MACHINERY') THEN 'Multilateral development banks'
    ELSE CASE iso WHEN 1 THEN 'Government and EU institutions' WHEN 3 THEN 'Government and EU institutions'
      WHEN 4 THEN 'Multilateral (including UN) agencies and funds' WHEN 6 THEN 'Private donors'
      WHEN 7 THEN 'Government and EU institutions' WHEN 8 THEN 'Government and EU institutions' END END AS donor_type,
  wb_region, round(usd_commitment * 1e6 / population, 6) AS usd_commitment_per_capita, coalesce(fragile, 0) AS fragile
FROM tx LEFT JOIN g USING (iso) LEFT JOIN pop USING (iso, year) LEFT JOIN fr USING (iso)
WHERE coalesce(usd_commitment, 0) + coalesce(usd_disbursement, 0) > 0""")
def enrich(spark, sf):
    """RL7 + FLT6 + JN4/JN5 + JN13 + SC25: the enrichment pipeline."""
    n = T(spark, sf, "nation")
    groups = n.select(F.col("n_nationkey").alias("iso"), F.col("n_regionkey").alias("wb_region"))
    fragile = n.where(F.col("n_regionkey") == 3).select(F.col("n_nationkey").alias("iso"), F.lit(1).alias("fragile"))
    out = E.enrich(_tx(spark, sf), amounts=["usd_commitment"], zero_cols=["usd_commitment", "usd_disbursement"],
                   code="iso", name="c_mktsegment", groups=groups, pop=_pop_long(spark, sf),
                   flags=[(fragile, {"fragile": 0})], iso="iso", year="year", override=["MACHINERY"])
    return out.select("o_orderkey", "donor_type", "wb_region",
                      r6(F.col("usd_commitment_per_capita")).alias("usd_commitment_per_capita"), "fragile")


def _auto(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", norm(F.col("text")).alias("text"))
    from .q_rules import NKW
    d = R.keyword_match(d, "text", NKW)
    return d.withColumn("key", F.md5("text"))


AUTO_SQL = f"""auto AS (SELECT doc_id, md5(t) AS key, {padded_any_sql('t', ['erst', 'on the', 'attion', 'ment', 'only', 'les', 'der'])} AS kw_paf,
  {padded_any_sql('t', ['only', 'les', 'der'])} AS kw_aa,
  {padded_any_sql('t', ['of the', 'thing', 'pour la', 'die der', 'thanedble'])} AS kw_cf
  FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents))"""


@query("review_merge", f"""WITH {AUTO_SQL},
rev AS (SELECT DISTINCT md5({norm_sql('d.text')}) AS key, CASE WHEN l.toxic = 1 THEN 'PAF' ELSE 'Not PAF' END AS review
        FROM labels l JOIN documents d USING (doc_id)),
kept AS (SELECT 'PAF' AS sheet, r.key, a.doc_id FROM (SELECT * FROM auto WHERE kw_paf) a
         RIGHT JOIN (SELECT * FROM rev WHERE review = 'PAF') r ON a.key = r.key),
child AS (SELECT 'AA' AS sheet, key, doc_id FROM auto a WHERE kw_aa
          AND NOT EXISTS (SELECT 1 FROM rev r WHERE r.review = 'Not PAF' AND r.key = a.key))
SELECT * FROM kept UNION ALL SELECT * FROM child""")
def review_merge(spark, sf):
    """RL5: reviewed-positive rows kept (right join), child hits minus
    reviewed negatives (anti join)."""
    auto = _auto(spark, sf)
    d = T(spark, sf, "documents").select("doc_id", F.md5(norm(F.col("text"))).alias("key"))
    rev = d.join(T(spark, sf, "labels"), "doc_id").select(
        "key", F.when(F.col("toxic") == 1, "PAF").otherwise("Not PAF").alias("Review"))
    kept, child = E.review_merge(auto, rev, "key", auto_hit=F.col("PAF keyword match"),
                                 child_hit=F.col("AA keyword match"))
    return kept.select(F.lit("PAF").alias("sheet"), "key", "doc_id").unionByName(
        child.select(F.lit("AA").alias("sheet"), "key", "doc_id"))


@query("version_compare", f"""WITH {AUTO_SQL},
manual AS (SELECT doc_id AS key FROM labels WHERE quality = 1),
known AS (SELECT DISTINCT key FROM manual WHERE key IN (SELECT doc_id FROM auto)),
flagged AS (SELECT DISTINCT doc_id AS key FROM auto WHERE kw_cf),
missed AS (SELECT key FROM known EXCEPT SELECT key FROM flagged),
new AS (SELECT key FROM flagged EXCEPT SELECT key FROM manual)
SELECT 'missed' AS kind, key FROM manual WHERE key IN (SELECT key FROM missed)
UNION ALL SELECT 'new', doc_id FROM auto WHERE kw_cf AND doc_id IN (SELECT key FROM new)""")
def version_compare(spark, sf):
    """RL6: missed and new keys between a manual list and an automatic run."""
    auto = _auto(spark, sf).withColumnRenamed("doc_id", "key_")
    auto = auto.withColumn("key", F.col("key_")).drop("key_")
    manual = T(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("key"))
    missed, new, _ = E.version_compare(manual, auto, "key", F.col("Crisis finance keyword match"))
    return missed.select(F.lit("missed").alias("kind"), "key").unionByName(new.select(F.lit("new").alias("kind"), "key"))


@query("consolidate", """SELECT o_orderstatus AS sheet, year(o_orderdate) AS year, count(*) AS n
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL""")
def consolidate(spark, sf):
    """RL8: rows of yearly sheets counted per sheet and year, in one scan (``sheets_by_year`` keeps them as partitions)."""
    year = F.year("o_orderdate")
    o = T(spark, sf, "orders").where(year.between(YEARS[0], YEARS[-1]))
    return o.groupBy(F.col("o_orderstatus").alias("sheet"), year.alias("year")).agg(F.count(F.lit(1)).alias("n"))


#: Texts of transactions: the order's clerk-like remark names an instrument or a fund for some orders.
REMARKS = ["Deferred drawdown, tranche", "IFRC DREF: floods", "sfera (dref) fund", "grant"]
DONORS = ["Asian Development Bank", "Other donor"]
PAF_SQL = f"""WITH {POP_SQL},
t AS (SELECT tx.*, p.population, ['Deferred drawdown, tranche', 'IFRC DREF: floods', 'sfera (dref) fund', 'grant'][o_orderkey % 4 + 1] AS remark,
        ['Asian Development Bank', 'Other donor'][o_orderkey % 2 + 1] AS donor, 2015 + o_orderkey % 9 AS fund_year,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Not PAF' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'PAF' END AS class
      FROM tx LEFT JOIN pop p USING (iso, year) WHERE coalesce(usd_commitment, 0) + coalesce(usd_disbursement, 0) > 0),
sh AS (SELECT *, CASE WHEN remark LIKE '%dref%' OR remark LIKE '%DREF%' THEN coalesce(map_extract(MAP {{2017: 0.0, 2018: 0.0, 2019: 0.024, 2020: 0.072, 2021: 0.033, 2022: 0.117}}, fund_year)[1],
        CASE WHEN remark LIKE 'sfera%' THEN map_extract(MAP {{2017: 0.104, 2018: 0.088, 2019: 0.313, 2020: 0.044, 2021: 0.288, 2022: 0.26}}, fund_year)[1] END, 1.0) ELSE 1.0 END AS share FROM t),
sheets AS (SELECT 'PAF' AS sheet, * FROM sh WHERE class <> 'Not PAF'
  UNION ALL SELECT 'AA', * FROM sh WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM sh WHERE class = 'Not PAF'))"""


@query("enrich_sheets", PAF_SQL + """
SELECT sheet, o_orderkey, CASE WHEN remark LIKE 'Deferred%' AND donor = 'Asian Development Bank' THEN 1 END AS contingent_financing,
  CAST(share AS DOUBLE) AS paf_imputed_share, round(usd_commitment * 1e6 * share, 6) AS commitment_imputed, round(usd_disbursement * 1e6 * share, 6) AS disbursement_imputed,
  round(usd_commitment * 1e6 / population * share, 6) AS commitment_imputed_per_capita, round(usd_disbursement * 1e6 / population * share, 6) AS disbursement_imputed_per_capita
FROM sheets""")
def enrich_sheets(spark, sf):
    """RL7 + SC25-SC28 on the PAF and AA sheets: contingent instruments, imputed shares, amounts and amounts per capita times the share;
    rows reviewed as no PAF leave both sheets."""
    amounts = ["usd_commitment", "usd_disbursement"]
    key = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    tx = _tx(spark, sf).withColumns({
        "text": norm(pick(REMARKS)), "donor": pick(DONORS), "fund_year": (F.lit(2015) + key % 9).cast("int"),
        "Classification": F.when(key % 5 == 0, "Not PAF").when(key % 13 == 0, F.lit(None)).otherwise("PAF")})
    full = E.enrich(tx, amounts=amounts, zero_cols=amounts, code="iso", name="c_mktsegment", pop=_pop_long(spark, sf), iso="iso", year="year")
    full = E.enrich_paf(full, "text", "donor", "fund_year", amounts)
    paf, aa = E.classified_sheets(full, full.where(key % 3 == 0), "o_orderkey")
    both = paf.withColumn("sheet", F.lit("PAF")).unionByName(aa.withColumn("sheet", F.lit("AA")))
    return both.select("sheet", "o_orderkey", "contingent_financing", F.col("paf_imputed_share").cast("double").alias("paf_imputed_share"),
                       *[r6(F.col(f"paf_usd_{c}_imputed{x}")).alias(f"{c}_imputed{x}") for c in ("commitment", "disbursement") for x in ("", "_per_capita")])


@query("earlier_review", f"""WITH {AUTO_SQL},
a AS (SELECT doc_id, key, CASE WHEN kw_paf AND doc_id % 2 = 0 THEN 'Yes' WHEN kw_paf THEN 'Review' ELSE 'No' END AS det FROM auto),
rev AS (SELECT a.key, bool_or(l.toxic = 1 OR l.quality = 0) AS yes FROM labels l JOIN a USING (doc_id) WHERE l.doc_id % 3 <> 0 AND det <> 'No' GROUP BY a.key),
mis AS (SELECT DISTINCT a.key FROM labels l JOIN a USING (doc_id) WHERE det = 'No' AND l.toxic = 1)
SELECT doc_id, CASE WHEN rev.yes THEN 'new' ELSE 'old' END AS origin FROM a LEFT JOIN rev USING (key) WHERE det <> 'No' AND coalesce(rev.yes, true)
UNION ALL SELECT doc_id, 'missed' FROM a JOIN mis USING (key)""")
def earlier_review(spark, sf):
    """RL5, earlier review: unlisted hits stay as old ones, listed hits where confirmed, missed rows are added."""
    auto = _auto(spark, sf).drop("text")
    kw = F.col("PAF keyword match")
    auto = auto.select("doc_id", "key", F.when(kw & (F.col("doc_id") % 2 == 0), "Yes").when(kw, "Review").otherwise("No").alias("PAF determination"))
    lab = T(spark, sf, "labels").join(auto, "doc_id")
    hit = F.col("PAF determination") != "No"
    review = lab.where(hit & (F.col("doc_id") % 3 != 0)).select("key", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "PAF").otherwise("Not PAF").alias("Review"))
    missed = lab.where(~hit & (F.col("toxic") == 1)).select("key")
    return RV.earlier_review(auto, review, missed, "key", "PAF determination").select("doc_id", "origin")


@query("sheets_by_year", """WITH last AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS flag FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus AS sheet, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN last ON o_orderkey = l_orderkey
WHERE flag IS DISTINCT FROM 'R' AND year(o_orderdate) >= 1996 GROUP BY ALL""")
def sheets_by_year(spark, sf):
    """RL5 + RL8: orders without those whose last entry of the change log is a return, written by sheet and year, one year written
    again, and read from the partitions asked for."""
    orders = T(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sheet"), F.year("o_orderdate").alias("year"), "o_totalprice")
    log = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    kept = RV.apply_decisions(orders, log, "o_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag", "R")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    RV.write_sheets(kept, root)
    RV.write_sheets(kept.where("year = 1997"), root)
    rows = RV.read_sheets(spark, root, F.col("year") >= 1996)
    return rows.groupBy("sheet", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
