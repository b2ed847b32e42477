"""Linkage queries (JN11-JN17, AG16, SC13-SC14, WN3, FLT7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link as K
from ..operators import project as P
from .common import T
from .registry import query


@query("lookup_last_wins", """
WITH m AS (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier
           WHERE s_acctbal > 0 GROUP BY s_nationkey)
SELECT c_custkey, m.s_name FROM customer LEFT JOIN m ON c_nationkey = m.s_nationkey""")
def lookup_last_wins(spark, sf):
    """JN11 + JN12: code -> ref dictionary where the last row per code wins;
    unmapped codes pass through as NULL."""
    s = T(spark, sf, "supplier").where(F.col("s_acctbal") > 0)
    m = K.lookup_last(s, "s_nationkey", "s_name", "s_suppkey")
    c = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    return K.lookup(c, m, "s_nationkey").select("c_custkey", "s_name")


@query("recode_override", """
SELECT n_nationkey, CASE WHEN n_name IN ('NATION_3', 'NATION_7', 'NATION_11') THEN 'Multilateral development banks'
  ELSE CASE n_regionkey WHEN 0 THEN 'Government and EU institutions' WHEN 1 THEN 'Government and EU institutions'
   WHEN 2 THEN 'Multilateral (including UN) agencies and funds' WHEN 3 THEN 'Private donors' END END AS donor_type
FROM nation""")
def recode_override(spark, sf):
    """JN13: dictionary recode of a code with an override name list."""
    m = {0: "Government and EU institutions", 1: "Government and EU institutions",
         2: "Multilateral (including UN) agencies and funds", 3: "Private donors"}
    n = T(spark, sf, "nation")
    return n.select("n_nationkey", K.recode_override("n_regionkey", m, "n_name",
                                                    ["NATION_3", "NATION_7", "NATION_11"],
                                                    "Multilateral development banks").alias("donor_type"))


def _activity_dates():
    """A pipe-delimited date list per order: order date, an unparsable
    marker for pending orders, and a later date."""
    o = F.col("o_orderdate")
    return F.concat_ws("|", F.date_format(o, "yyyy-MM-dd"),
                       F.when(F.col("o_orderstatus") == "P", F.lit("pending")),
                       F.date_format(F.date_add(o, (F.col("o_totalprice") / 250).cast("int")), "yyyy-MM-dd"))


DATES_SQL = """concat_ws('|', strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderstatus = 'P' THEN 'pending' END,
  strftime(o_orderdate + to_days(CAST(trunc(o_totalprice / 250) AS INTEGER)), '%Y-%m-%d'))"""
BOUNDS_SQL = f"""reg AS (SELECT o_orderkey, o_custkey, o_orderstatus, {DATES_SQL} AS dates FROM orders),
bnd AS (SELECT *, coalesce(list_min(list_filter(list_transform(string_split(dates, '|'),
                     lambda x: TRY_CAST(substr(x, 1, 4) AS INTEGER)), lambda y: y IS NOT NULL)), 9999) AS min_year,
                  coalesce(list_max(list_filter(list_transform(string_split(dates, '|'),
                     lambda x: TRY_CAST(substr(x, 1, 4) AS INTEGER)), lambda y: y IS NOT NULL)), 0) AS max_year FROM reg)"""


def _bounds(spark, sf):
    o = T(spark, sf, "orders").withColumn("dates", _activity_dates())
    lo, hi = K.date_bounds("dates")
    return o.withColumns({"min_year": lo, "max_year": hi})


@query("date_bounds", f"WITH {BOUNDS_SQL} SELECT o_orderkey, dates, min_year, max_year FROM bnd")
def date_bounds(spark, sf):
    """AG16 + SC13 + SC14: min/max year over a '|' list, bad pieces skipped."""
    return _bounds(spark, sf).select("o_orderkey", "dates", "min_year", "max_year")


@query("interval_join", f"""WITH {BOUNDS_SQL}
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN bnd b
  ON a.o_custkey = b.o_custkey AND year(a.o_orderdate) BETWEEN b.min_year AND b.max_year
WHERE b.o_orderstatus = 'F'""")
def interval_join(spark, sf):
    """JN14: same customer (block) and year inside the register interval."""
    a = T(spark, sf, "orders").select(F.col("o_orderkey").alias("a_key"), F.col("o_custkey").alias("blk"),
                                      F.year("o_orderdate").alias("yr"))
    b = _bounds(spark, sf).where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("b_key"), F.col("o_custkey").alias("bblk"), "min_year", "max_year")
    return K.interval_join(a, b, "blk", "bblk", "yr", "min_year", "max_year").select("a_key", "b_key")


CONTAINS_SQL = """SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
  ON contains(lower(d.text), lower(b.text))"""


@query("contains_join", CONTAINS_SQL)
def contains_join(spark, sf):
    """JN15: needle texts found inside documents, case-insensitive, by anchors of hashed grams."""
    return K.contains_join(T(spark, sf, "benchmark"), T(spark, sf, "documents"),
                           "item_id", "text", "doc_id", "text")


@query("contains_join_token", CONTAINS_SQL)
def contains_join_token(spark, sf):
    """JN15 (interior-token index form): must equal the hashed form."""
    return K.contains_join(T(spark, sf, "benchmark"), T(spark, sf, "documents"),
                           "item_id", "text", "doc_id", "text", method="token")


def _line(i):
    return F.try_element_at(F.split(F.col("text"), "\n"), F.lit(i))


LINK_SQL = """WITH t AS (
  SELECT doc_id, source AS blk, CAST(doc_id AS VARCHAR) AS num,
         string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS short,
         string_split(text, chr(10))[3] AS long FROM documents),
r AS (SELECT doc_id AS pos, source AS blk, source || '-' || CAST(doc_id AS VARCHAR) AS ident, text FROM documents),
nd AS (
  SELECT doc_id, blk, 0 AS stage, CASE WHEN starts_with(num, blk) THEN num ELSE blk || '-' || num END AS needle
    FROM t WHERE num IS NOT NULL
  UNION ALL SELECT doc_id, blk, 1, title FROM t WHERE title IS NOT NULL AND length(title) > 20
  UNION ALL SELECT doc_id, blk, 2, short FROM t WHERE short IS NOT NULL AND length(short) > 20
  UNION ALL SELECT doc_id, blk, 3, long FROM t WHERE long IS NOT NULL AND length(long) > 20),
pairs AS (SELECT nd.doc_id, nd.stage, r.pos FROM nd JOIN r ON nd.blk = r.blk
  AND contains(lower(CASE WHEN nd.stage = 0 THEN r.ident ELSE r.text END), lower(nd.needle))),
agg AS (SELECT doc_id, stage, count(*) AS n, min(pos) AS first_pos FROM pairs GROUP BY ALL),
win AS (SELECT doc_id, min(stage) AS stage, arg_min(first_pos, stage) AS pos FROM agg
        WHERE n BETWEEN 1 AND 5 GROUP BY doc_id)
SELECT t.doc_id, coalesce(r.ident, '') AS matched_identifier, coalesce(r.text, '') AS matched_text,
  coalesce(['identifier', 'project title', 'short description', 'long description'][win.stage + 1], '') AS match_type
FROM t LEFT JOIN win USING (doc_id) LEFT JOIN r ON r.pos = win.pos"""


def _link(spark, sf):
    d = T(spark, sf, "documents")
    a = d.select("doc_id", F.col("source").alias("blk"), F.col("doc_id").cast("string").alias("num"),
                 _line(1).alias("title"), _line(2).alias("short"), _line(3).alias("long"))
    b = d.select(F.col("doc_id").alias("pos"), F.col("source").alias("rblk"),
                 F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("ident"), "text")
    return K.link_cascade(a, b, a_id="doc_id", a_block="blk", number="num", texts=["title", "short", "long"],
                          b_pos="pos", b_ident="ident", b_text="text", b_block="rblk")


@query("link_cascade", LINK_SQL)
def link_cascade(spark, sf):
    """JN16 + JN17 + WN3: identifier -> title -> short -> long cascade over the
    documents register, blocked by source; a stage wins with 1..5 matches."""
    return _link(spark, sf).select("doc_id", "matched_identifier", "matched_text", "match_type")


#: A register other than the transactions: pages, by the language they state; years from a list of dates.
#: Transactions: documents; a project number is missing, bare or already prefixed with the donor's reference.
ORG_REFS = {"en": "XM-EN", "fr": "XM-FR", "de": "XM-DE"}
REGISTER_SQL = """WITH reg AS (
  SELECT page_id AS pos, 'XM-' || upper(regexp_extract(html, 'lang="([a-z]+)"', 1)) AS blk,
         'XM-' || upper(regexp_extract(html, 'lang="([a-z]+)"', 1)) || '-' || CAST(page_id AS VARCHAR) AS ident, html AS text,
         2012 + page_id % 6 AS lo, CASE WHEN page_id % 9 = 0 THEN 2016 ELSE 2017 + page_id % 8 END AS hi FROM pages),
r AS (SELECT * FROM reg WHERE hi >= 2017 AND blk IN ('XM-EN', 'XM-FR', 'XM-DE')),
t AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'XM-EN' WHEN 'fr' THEN 'XM-FR' WHEN 'de' THEN 'XM-DE' END AS blk, 2013 + doc_id % 11 AS yr,
         CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 AND lang IN ('en', 'fr', 'de') THEN 'XM-' || upper(lang) || '-' || CAST(doc_id AS VARCHAR)
              ELSE CAST(doc_id AS VARCHAR) END AS num,
         string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS short,
         array_to_string(string_split(text, chr(10))[3:], chr(10)) AS long FROM documents),
nd AS (
  SELECT doc_id, blk, yr, 0 AS stage, CASE WHEN starts_with(num, blk) THEN num ELSE blk || '-' || num END AS needle FROM t WHERE num IS NOT NULL
  UNION ALL SELECT doc_id, blk, yr, 1, title FROM t WHERE length(title) > 20
  UNION ALL SELECT doc_id, blk, yr, 2, short FROM t WHERE length(short) > 20
  UNION ALL SELECT doc_id, blk, yr, 3, long FROM t WHERE length(long) > 20),
agg AS (SELECT doc_id, stage, count(*) AS n, min(pos) AS first_pos FROM nd JOIN r ON nd.blk = r.blk AND nd.yr BETWEEN r.lo AND r.hi
        AND contains(lower(CASE WHEN nd.stage = 0 THEN r.ident ELSE r.text END), lower(nd.needle)) GROUP BY ALL),
win AS (SELECT doc_id, min(stage) AS stage, arg_min(first_pos, stage) AS pos FROM agg WHERE n BETWEEN 1 AND 5 GROUP BY doc_id)"""


def _register_link(spark, sf):
    d, p = T(spark, sf, "documents"), T(spark, sf, "pages")
    donors = F.broadcast(spark.createDataFrame(list(ORG_REFS.items()), "lang string, blk string"))  # a few rows: documents are not shuffled by language
    lines = F.split("text", "\n")
    a = K.lookup(d.select("doc_id", "lang", "text"), donors, "lang").select(
        "doc_id", "blk", (F.lit(2013) + F.col("doc_id") % 11).cast("int").alias("yr"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when((F.col("doc_id") % 4 == 1) & F.col("blk").isNotNull(), F.concat_ws("-", "blk", F.col("doc_id").cast("string")))
        .otherwise(F.col("doc_id").cast("string")).alias("num"),
        F.try_element_at(lines, F.lit(1)).alias("title"), F.try_element_at(lines, F.lit(2)).alias("short"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), "\n").alias("long"))
    ref = F.concat(F.lit("XM-"), F.upper(F.regexp_extract("html", 'lang="([a-z]+)"', 1)))
    dates = F.concat(F.lit(2012) + F.col("page_id") % 6, F.lit("-03-01|planned|"),
                     F.when(F.col("page_id") % 9 == 0, F.lit(2016)).otherwise(F.lit(2017) + F.col("page_id") % 8).cast("string"), F.lit("-11-30"))
    lo, hi = K.date_bounds(dates)
    b = p.select(F.col("page_id").alias("pos"), ref.alias("rblk"), F.concat(ref, F.lit("-"), F.col("page_id").cast("string")).alias("ident"),
                 F.col("html").alias("text"), lo.alias("lo"), hi.alias("hi"))
    b = b.join(F.broadcast(donors.select(F.col("blk").alias("rblk"))), "rblk", "left_semi").where("hi >= 2017")
    return K.link_cascade(a, b, a_id="doc_id", a_block="blk", number="num", texts=["title", "short", "long"], b_pos="pos", b_ident="ident",
                          b_text="text", b_block="rblk", year="yr", b_lo="lo", b_hi="hi", over="over_five")


@query("link_cascade_register", REGISTER_SQL + """
SELECT t.doc_id, coalesce(r.ident, '') AS matched_identifier, coalesce(md5(r.text), '') AS matched_text_md5,
  coalesce(['identifier', 'project title', 'short description', 'long description'][win.stage + 1], '') AS match_type,
  coalesce((SELECT max(n) FROM agg WHERE agg.doc_id = t.doc_id), 0) > 5 AS over_five
FROM t LEFT JOIN win USING (doc_id) LEFT JOIN r ON r.pos = win.pos""")
def link_cascade_register(spark, sf):
    """JN11-JN17, AG16: documents linked to a register of pages: donor map, year inside the activity's dates, then number,
    title, short and long description, where a stage wins with 1..5 matches; ``over_five``: some stage had more."""
    out = _register_link(spark, sf)
    return out.select("doc_id", "matched_identifier", F.when(F.col("matched_text") == "", "").otherwise(F.md5("matched_text")).alias("matched_text_md5"),
                      "match_type", "over_five")


@query("strong_match", f"""WITH lk AS ({LINK_SQL}), t2 AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents)
SELECT doc_id, match_type FROM lk JOIN t2 USING (doc_id)
WHERE match_type = 'identifier' OR (match_type <> '' AND length(title) > 20)""")
def strong_match(spark, sf):
    """FLT7: keep identifier matches and text matches with a >20-char title."""
    lk = _link(spark, sf)
    return P.strong_match(lk, "match_type", "title", "matched_text").select("doc_id", "match_type")


WEAK_SQL = """ok AS (SELECT t.doc_id, ['identifier', 'project title', 'short description', 'long description'][win.stage + 1] AS match_type,
  md5(r.text) AS linked, win.stage = 0 OR length(t.title) > 20 AS strong FROM t LEFT JOIN win USING (doc_id) LEFT JOIN r ON r.pos = win.pos)"""


@query("strong_match_register", REGISTER_SQL + f""", {WEAK_SQL}
SELECT doc_id, match_type FROM ok WHERE match_type IS NOT NULL AND strong""")
def strong_match_register(spark, sf):
    """FLT7: links by number, and links by text of documents whose title is longer than 20; unmatched rows go."""
    return P.strong_match(_register_link(spark, sf), "match_type", "title", "matched_text").select("doc_id", "match_type")


@query("strong_match_blank", REGISTER_SQL + f""", {WEAK_SQL}
SELECT doc_id, coalesce(match_type, '') AS match_type, CASE WHEN match_type IS NOT NULL AND strong THEN linked ELSE '' END AS linked_md5 FROM ok""")
def strong_match_blank(spark, sf):
    """FLT7, blanking form: every row stays, and weak links lose their text."""
    out = P.strong_match(_register_link(spark, sf), "match_type", "title", "matched_text", blank=True)
    return out.select("doc_id", "match_type", F.when(F.col("matched_text") == "", "").otherwise(F.md5("matched_text")).alias("linked_md5"))
