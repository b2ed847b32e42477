"""Rule-engine queries (JN18, SC10-SC11, SC30, RL1-RL4, PRJ9-PRJ11, FLT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords as KW
from ..operators import rules as R
from .common import T, norm, norm_sql, padded_any_sql
from .registry import query

# Driver keyword dimension in the reference's (keyword, category) format.
# The driver's prose is invented, so the words are ones that occur in it;
# case, hyphens and trailing blanks exercise the normaliser.
KEYWORDS = [
    ("Of the", "CF"), ("thing", "CF"), ("Pour-la", "CF"), ("die der", "CF"),
    ("thanedble", "CF"), ("erst", "PAF"), ("On the", "PAF"), ("attion", "PAF"),
    ("ment ", "PAF"), ("only", "AA"), ("les", "AA"), ("Der", "AA"),
]
# stand-ins for relief / debt relief / bad-relief names
RELIEF, DEBT, BAD = "and", "and the", ["The by", "in-the"]
NKW = R.normalise_keywords(KEYWORDS, "ascii")
NKW_R = R.normalise_keywords(KEYWORDS, "ascii", drop=(RELIEF,))
IDENT_SOURCES, ELIG_LANGS, HUM_SOURCES = ["src1", "src2"], ["en", "fr"], ["src5"]


def doc_base(spark, sf):
    """documents with code flags and normalised text: all of the scan."""
    return T(spark, sf, "documents").select("doc_id", "text", "lang", "source").withColumns({
        "humanitarian": R.code_flag("source", HUM_SOURCES),
        "Crisis finance identified": R.code_flag("source", IDENT_SOURCES),
        "Crisis finance eligible": R.code_flag("lang", ELIG_LANGS),
        "text": norm(F.col("text")),
    })


def with_predictions(flags, spark, sf):
    """Flags of documents (no text) with the labels as model stand-ins."""
    q, tx = F.col("quality"), F.col("toxic")
    return flags.join(T(spark, sf, "labels"), "doc_id", "left").withColumns({
        "Crisis finance predicted ML": F.coalesce(q == 1, F.lit(False)),
        "PAF predicted ML": F.coalesce((q == 1) & (tx == 0), F.lit(False)),
        "AA predicted ML": F.coalesce(tx == 1, F.lit(False)),
    })


def _fam(nkw):
    return {name: sorted({k for k, c in nkw if c in cats}) for name, cats in R.LABEL_FAMILIES.items()}


BASE_SQL = f"""base AS (
  SELECT d.doc_id, d.lang, d.source, {norm_sql('d.text')} AS text,
         d.source IN ('src5') AS humanitarian,
         d.source IN ('src1','src2') AS ident, d.lang IN ('en','fr') AS elig,
         coalesce(l.quality = 1, false) AS m_cf,
         coalesce(l.quality = 1 AND l.toxic = 0, false) AS m_paf,
         coalesce(l.toxic = 1, false) AS m_aa
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _kw_sql(nkw):
    f = _fam(nkw)
    return (f"{padded_any_sql('text', f['Crisis finance'])} AS kw_cf, "
            f"{padded_any_sql('text', f['PAF'])} AS kw_paf, "
            f"{padded_any_sql('text', f['AA'])} AS kw_aa")


def _kw_spark(spark, sf, method):
    df = R.keyword_match(doc_base(spark, sf), "text", NKW, method=method)
    return df.select("doc_id", F.col("Crisis finance keyword match").alias("kw_cf"),
                     F.col("PAF keyword match").alias("kw_paf"),
                     F.col("AA keyword match").alias("kw_aa"))


KW_SQL = f"WITH {BASE_SQL} SELECT doc_id, {_kw_sql(NKW)} FROM base"


@query("keyword_match", KW_SQL)
def keyword_match(spark, sf):
    return _kw_spark(spark, sf, "rlike")


@query("keyword_match_ngram", KW_SQL)
def keyword_match_ngram(spark, sf):
    return _kw_spark(spark, sf, "ngram")


#: A keyword table taken from the data: all runs of 1 to 3 words of benchmark texts, by their length.
TABLE_SQL = f"""bw AS (SELECT string_split({norm_sql('text')}, ' ') AS w FROM benchmark),
kt AS (SELECT DISTINCT g, n FROM (SELECT array_to_string(w[i:i + n - 1], ' ') AS g, n FROM (
  SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw, range(1, 4) t(n)))),
dw AS (SELECT doc_id, string_split({norm_sql('text')}, ' ') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g, n FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, range(1, 4) t(n)))"""


@query("keyword_match_table", f"""WITH {TABLE_SQL},
hit AS (SELECT doc_id, bool_or(n = 1) AS aa, bool_or(n = 2) AS paf, bool_or(n = 3) AS cf FROM dg JOIN kt USING (g, n) WHERE g <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(cf, false) AS kw_cf, coalesce(paf OR aa, false) AS kw_paf, coalesce(aa, false) AS kw_aa FROM documents LEFT JOIN hit USING (doc_id)""")
def keyword_match_table(spark, sf):
    """JN18 with the keywords as a table: a hash join on each keyword's rarest token, verified in place."""
    w = F.split(norm("text"), " ")
    grams = T(spark, sf, "benchmark").select(F.posexplode(w).alias("i", "x"), w.alias("w")).select(F.explode(F.array(*[
        F.struct(F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("keyword"), F.lit(cat).alias("category"), (F.col("i") + n <= F.size("w")).alias("whole"))
        for n, cat in ((1, "AA"), (2, "PAF"), (3, "CF"))])).alias("g")).select("g.*").where("whole").drop("whole")
    docs = T(spark, sf, "documents").select("doc_id", norm("text").alias("text"))
    out = KW.keyword_flags(docs, "doc_id", "text", grams, punct="ascii")
    return out.select("doc_id", F.col("Crisis finance keyword match").alias("kw_cf"), F.col("PAF keyword match").alias("kw_paf"),
                      F.col("AA keyword match").alias("kw_aa"))


BAD_N = [k for k, _ in R.normalise_keywords([(b, "") for b in BAD], "ascii")]
RELIEF_SQL = f"""WITH {BASE_SQL},
k AS (SELECT *, {_kw_sql(NKW_R)},
        {padded_any_sql('text', [RELIEF])} AS c_relief,
        {padded_any_sql('text', BAD_N)} AS c_bad,
        {padded_any_sql('text', [DEBT])} AS c_debt FROM base),
r1 AS (SELECT *, kw_cf OR (c_relief AND NOT c_bad AND NOT c_debt) AS kw1 FROM k),
r2 AS (SELECT *, c_debt AND NOT kw1 AS only_debt, kw1 OR c_debt AS kw_cf2 FROM r1)"""


def relief_frame(spark, sf):
    df = R.keyword_match(doc_base(spark, sf), "text", NKW_R)
    df = R.relief_flags(df, "text", "ascii", RELIEF, DEBT, BAD)
    return R.relief_rule(df, variant="r")


@query("relief_rule", RELIEF_SQL + """
SELECT doc_id, c_relief AS contains_relief, c_bad AS contains_bad_relief,
       c_debt AS contains_debt_relief, only_debt AS only_debt_relief, kw_cf2 AS cf_keyword_match
FROM r2""")
def relief_rule(spark, sf):
    return relief_frame(spark, sf).select(
        "doc_id", F.col("Contains relief").alias("contains_relief"),
        F.col("Contains bad relief").alias("contains_bad_relief"),
        F.col("Contains debt relief").alias("contains_debt_relief"),
        F.col("Only debt relief").alias("only_debt_relief"),
        F.col("Crisis finance keyword match").alias("cf_keyword_match"))


DET_SQL = RELIEF_SQL + """,
d1 AS (SELECT *,
  CASE WHEN ident THEN 'Yes'
       WHEN (ident OR elig) AND kw_cf2 AND m_cf THEN 'Yes'
       WHEN (ident OR elig) AND kw_cf2 THEN 'Review' ELSE 'No' END AS cf0,
  CASE WHEN kw_paf AND m_paf THEN 'Yes' WHEN kw_paf THEN 'Review' ELSE 'No' END AS paf_det,
  CASE WHEN kw_aa AND m_aa THEN 'Yes' WHEN kw_aa THEN 'Review' ELSE 'No' END AS aa_det
  FROM r2),
d2 AS (SELECT *, CASE WHEN cf0 = 'Yes' AND only_debt THEN 'Review' ELSE cf0 END AS cf_det FROM d1)"""


def det_frame(spark, sf):
    return R.determine(with_predictions(relief_frame(spark, sf).drop("text"), spark, sf))


@query("determination", DET_SQL + """
SELECT doc_id, cf_det AS cf_determination, paf_det AS paf_determination,
       aa_det AS aa_determination FROM d2""")
def determination(spark, sf):
    return det_frame(spark, sf).select(
        "doc_id", F.col("Crisis finance determination").alias("cf_determination"),
        F.col("PAF determination").alias("paf_determination"),
        F.col("AA determination").alias("aa_determination"))


PROP_SQL = DET_SQL + """,
o AS (SELECT *, CASE cf_det WHEN 'Yes' THEN 2 WHEN 'Review' THEN 1 ELSE 0 END AS o_cf,
                CASE paf_det WHEN 'Yes' THEN 2 WHEN 'Review' THEN 1 ELSE 0 END AS o_paf,
                CASE aa_det WHEN 'Yes' THEN 2 WHEN 'Review' THEN 1 ELSE 0 END AS o_aa FROM d2),
p AS (SELECT *, greatest(o_paf, o_aa) AS p_paf FROM o),
q AS (SELECT *, greatest(o_cf, p_paf) AS p_cf FROM p),
fin AS (SELECT doc_id, source,
  CASE WHEN humanitarian THEN 'Yes' ELSE CASE p_cf WHEN 2 THEN 'Yes' WHEN 1 THEN 'Review' ELSE 'No' END END AS cf_determination,
  CASE p_paf WHEN 2 THEN 'Yes' WHEN 1 THEN 'Review' ELSE 'No' END AS paf_determination,
  aa_det AS aa_determination,
  humanitarian OR aa_det = 'Yes' AS humanitarian FROM q)"""


def prop_frame(spark, sf):
    return R.propagate_determination(det_frame(spark, sf))


@query("determination_propagate", PROP_SQL + " SELECT * EXCLUDE (source) FROM fin")
def determination_propagate(spark, sf):
    return prop_frame(spark, sf).select(
        "doc_id", F.col("Crisis finance determination").alias("cf_determination"),
        F.col("PAF determination").alias("paf_determination"),
        F.col("AA determination").alias("aa_determination"), "humanitarian")


@query("determination_counts", PROP_SQL + """
SELECT source, cf_determination, count(*) AS n FROM fin GROUP BY ALL""")
def determination_counts(spark, sf):
    """Flagship: rule engine end to end, then AG1 value counts by source."""
    return (prop_frame(spark, sf)
            .groupBy("source", F.col("Crisis finance determination").alias("cf_determination"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("double_count_guard", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE NOT (l_suppkey IS NOT DISTINCT FROM 7 AND l_partkey IS DISTINCT FROM 7)""")
def double_count_guard(spark, sf):
    """FLT2 on lineitem: drop lines whose supplier (channel stand-in) is 7
    unless the part (donor stand-in) is 7 as well."""
    li = T(spark, sf, "lineitem")
    return R.drop_double_count(li, "l_suppkey", "l_partkey", 7).select("l_orderkey", "l_linenumber")


@query("blank_reset", """
WITH b AS (
  SELECT d.doc_id, CASE WHEN d.n_chars < 200 THEN '-' ELSE d.lang END AS t,
         coalesce(l.quality = 1, false) AS pred,
         CAST(coalesce(l.quality, 0) AS DOUBLE) * 0.75 AS conf
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id,
       CASE WHEN coalesce(t, '') IN ('', '-') THEN false ELSE pred END AS pred,
       CASE WHEN coalesce(t, '') IN ('', '-') THEN 0.0 ELSE conf END AS conf
FROM b""")
def blank_reset(spark, sf):
    """PRJ10: documents shorter than 200 chars get a '-' title (a blank
    record); their prediction/confidence are reset."""
    d = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    d = d.select("doc_id",
                 F.when(F.col("n_chars") < 200, F.lit("-")).otherwise(F.col("lang")).alias("t"),
                 F.coalesce(F.col("quality") == 1, F.lit(False)).alias("pred"),
                 (F.coalesce(F.col("quality"), F.lit(0)).cast("double") * 0.75).alias("conf"))
    return R.reset_blank(d, ["t"], ["pred"], ["conf"]).select("doc_id", "pred", "conf")


@query("bool_blank", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE '' END AS is_f,
       CASE WHEN o_totalprice > 200000 THEN 'TRUE' ELSE '' END AS is_big
FROM orders""")
def bool_blank(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_f"),
                                      (F.col("o_totalprice") > 200000).alias("is_big"))
    return R.bool_blank(o, ["is_f", "is_big"])


#: The whole run on transactions made of documents: codes by id out of the fixed lists and beside them.
PURPOSES, CHANNELS, NAMES = [72010, 12220, 99999, 15220, None], [10000, 21016, None, 41121, 10000, 10000], [R.CERF_NAME, "Other agency", None]


def _pick(values, column="doc_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(values, column="doc_id"):
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{column} % {len(values)} + 1]"


def _in_sql(c, codes):
    return f"coalesce({c} IN ({', '.join(map(str, codes))}), false)"


RUN_SQL = f"""WITH tx AS (
  SELECT doc_id, {_pick_sql(PURPOSES)} AS purpose, {_pick_sql(CHANNELS)} AS channel, {_pick_sql(NAMES)} AS channel_name,
         CASE WHEN doc_id % 7 = 0 THEN '{R.CERF_NAME}' ELSE 'Donor' END AS donor,
         CASE WHEN doc_id % 11 = 0 THEN '-' ELSE string_split(text, chr(10))[1] END AS title,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE array_to_string(string_split(text, chr(10))[2:], chr(10)) END AS long FROM documents),
base AS (
  SELECT doc_id, {norm_sql("concat_ws(' ', title, long)")} AS text, {_in_sql('purpose', R.HUMANITARIAN_PURPOSE_CODES)} AS humanitarian,
         {_in_sql('channel', R.IDENTIFIED_CHANNEL_CODES)} OR {_in_sql('purpose', R.IDENTIFIED_PURPOSE_CODES)} AS ident,
         {_in_sql('purpose', R.ELIGIBLE_PURPOSE_CODES)} AS elig, '' AS source, doc_id % 11 <> 0 AND coalesce(quality = 1, false) AS m_cf,
         doc_id % 11 <> 0 AND coalesce(quality = 1 AND toxic = 0, false) AS m_paf, doc_id % 11 <> 0 AND coalesce(toxic = 1, false) AS m_aa
  FROM tx LEFT JOIN labels USING (doc_id) WHERE NOT (channel_name IS NOT DISTINCT FROM '{R.CERF_NAME}' AND donor IS DISTINCT FROM '{R.CERF_NAME}'))"""


@query("rule_run", RUN_SQL + PROP_SQL.split("FROM documents d LEFT JOIN labels l USING (doc_id))", 1)[1] + """
SELECT fin.doc_id, cf_determination, paf_determination, aa_determination, CASE WHEN fin.humanitarian THEN 'TRUE' ELSE '' END AS humanitarian,
  CASE WHEN b.m_cf THEN 'TRUE' ELSE '' END AS cf_predicted FROM fin JOIN base b USING (doc_id)""")
def rule_run(spark, sf):
    """E1 as a run: FLT2 (routed through a fund that another donor reports), SC30 with the fixed code lists, PRJ9-PRJ10 (blank texts
    lose their predictions), text of several columns, JN18, RL1-RL4, PRJ11 (booleans as text)."""
    lines = F.split("text", "\n")
    blank = F.col("doc_id") % 11 == 0
    tx = T(spark, sf, "documents").select(
        "doc_id", _pick(PURPOSES).alias("purpose_code"), _pick(CHANNELS).alias("channel_code"), _pick(NAMES).alias("channel_name"),
        F.try_element_at(lines, F.lit(1)).alias("title"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n").alias("long"))
    tx = R.update_where(tx.withColumn("donor", F.lit("Donor")), "donor", F.col("doc_id") % 7 == 0, R.CERF_NAME)
    tx = R.update_where(R.update_where(tx, "title", blank, "-"), "long", blank, F.lit(None).cast("string"))
    tx = R.add_code_flags(R.drop_double_count(tx, "channel_name", "donor"))
    empty = F.coalesce("title", F.lit("")).isin("", "-") & F.coalesce("long", F.lit("")).isin("", "-")
    flags = R.rule_flags(tx.withColumn("t", F.when(empty, "").otherwise("x")), ["title", "long"], KEYWORDS, punct="ascii", relief=RELIEF, debt=DEBT, bad=BAD)
    flags = with_predictions(flags.drop("text", "title", "long"), spark, sf)
    preds = [f"{label} predicted ML" for label in R.LABEL_FAMILIES]
    out = R.propagate_determination(R.determine(R.reset_blank(flags, ["t"], preds, [])))
    out = R.bool_blank(out, ["humanitarian", preds[0]])
    return out.select("doc_id", *[F.col(f"{label} determination").alias(f"{k}_determination") for label, k in (("Crisis finance", "cf"), ("PAF", "paf"), ("AA", "aa"))],
                      "humanitarian", F.col(preds[0]).alias("cf_predicted"))
