"""Training-table and IO queries (ML17-ML19, SC18, SRC1-SRC8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import training as TR
from ..operators.sample import hash_split
from ..session import ensure_checkpoint_dir
from ..sources import csv_records as CSV
from ..sources import files as IO
from .common import LABELLED_SQL, T, labelled_docs
from .registry import query


def _lines(i):
    return F.try_element_at(F.split(F.col("text"), "\n"), F.lit(i))


def _rest(i):
    """All lines from the ``i``-th, joined by blanks."""
    lines = F.split(F.col("text"), "\n")
    return F.array_join(F.slice(lines, i, F.greatest(F.size(lines), F.lit(1))), " ")


def _training_table(spark, sf, texts):
    d = T(spark, sf, "documents")
    reg = d.select("doc_id", "source", *[c.alias(n) for n, c in texts.items()])
    lab = T(spark, sf, "labels").join(d.select("doc_id", "source", "lang"), "doc_id")
    cf = lab.where(F.col("quality") == 1).select("doc_id", "source")
    paf = lab.where(F.col("toxic") == 1).select("doc_id", "source", F.col("lang").alias("typ"))
    out, _ = TR.training_table(reg, {"Crisis financing": cf, "PAF": paf}, ["doc_id", "source"],
                               list(texts), "typ", {"en": "Direct", "fr": "Indirect", "de": "Both"})
    return out.select(F.md5("text").alias("text_key"), "labels").distinct()


@query("training_table", """
WITH r AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS short FROM documents),
cf AS (SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1),
paf AS (SELECT l.doc_id, d.source, CASE d.lang WHEN 'en' THEN 'Direct' WHEN 'fr' THEN 'Indirect' WHEN 'de' THEN 'Both' END AS typ
        FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1),
m AS (SELECT r.*, cf.doc_id IS NOT NULL AS is_cf, paf.doc_id IS NOT NULL AS is_paf, paf.typ FROM r
      LEFT JOIN cf ON r.doc_id IS NOT DISTINCT FROM cf.doc_id AND r.source IS NOT DISTINCT FROM cf.source
      LEFT JOIN paf ON r.doc_id IS NOT DISTINCT FROM paf.doc_id AND r.source IS NOT DISTINCT FROM paf.source)
SELECT DISTINCT md5(trim(concat_ws(' ', title, short))) AS text_key,
  CASE WHEN concat_ws(',', CASE WHEN is_cf THEN 'Crisis financing' END, CASE WHEN is_paf THEN 'PAF' END, typ) = '' THEN 'Unrelated'
       ELSE concat_ws(',', CASE WHEN is_cf THEN 'Crisis financing' END, CASE WHEN is_paf THEN 'PAF' END, typ) END AS labels
FROM m""")
def training_table(spark, sf):
    """ML18: labelled sheets merged onto the register, label list per text.
    The text is the first two lines; ``training_table_whole`` has all."""
    return _training_table(spark, sf, {"title": _lines(1), "short": _lines(2)})


@query("training_table_whole", """
WITH r AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2] AS short,
             array_to_string(string_split(text, chr(10))[3:], ' ') AS long FROM documents),
cf AS (SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1),
paf AS (SELECT l.doc_id, d.source, CASE d.lang WHEN 'en' THEN 'Direct' WHEN 'fr' THEN 'Indirect' WHEN 'de' THEN 'Both' END AS typ
        FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1),
m AS (SELECT r.*, cf.doc_id IS NOT NULL AS is_cf, paf.doc_id IS NOT NULL AS is_paf, paf.typ FROM r
      LEFT JOIN cf ON r.doc_id IS NOT DISTINCT FROM cf.doc_id AND r.source IS NOT DISTINCT FROM cf.source
      LEFT JOIN paf ON r.doc_id IS NOT DISTINCT FROM paf.doc_id AND r.source IS NOT DISTINCT FROM paf.source),
t AS (SELECT concat_ws(' ', title, short, long) AS text,
        concat_ws(',', CASE WHEN is_cf THEN 'Crisis financing' END, CASE WHEN is_paf THEN 'PAF' END, typ) AS labels FROM m)
SELECT DISTINCT md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_key, CASE WHEN labels = '' THEN 'Unrelated' ELSE labels END AS labels
FROM t""")
def training_table_whole(spark, sf):
    """ML18 on whole texts: the first line, the second and all the rest."""
    return _training_table(spark, sf, {"title": _lines(1), "short": _lines(2), "long": _rest(3)})


LABEL_SQL = """WITH s AS (SELECT l.doc_id, d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)),
cf AS (SELECT DISTINCT doc_id, source FROM s WHERE quality = 1),
paf AS (SELECT DISTINCT doc_id, source, CASE lang WHEN 'en' THEN 'Direct' WHEN 'fr' THEN 'Indirect' WHEN 'de' THEN 'Direct,Indirect' WHEN 'es' THEN 'Part' END AS typ,
          CASE WHEN source IN ('src1', 'src0') THEN 'WB CAT DDO' END AS ddo, CASE WHEN doc_id % 3 = 0 THEN 'Contingent financing' END AS cont FROM s WHERE toxic = 1),
aa AS (SELECT DISTINCT doc_id, source, CASE WHEN source = 'src0' THEN 'Direct,Indirect' WHEN doc_id % 2 = 0 THEN CASE lang WHEN 'en' THEN 'Direct' WHEN 'fr' THEN 'Indirect'
          WHEN 'de' THEN 'Direct,Indirect' WHEN 'es' THEN 'Part' END END AS typ FROM s WHERE (toxic = 1 AND doc_id % 2 = 0) OR (quality = 1 AND doc_id % 10 = 0)),
k AS (SELECT doc_id, source FROM cf UNION SELECT doc_id, source FROM paf UNION SELECT doc_id, source FROM aa),
m AS (SELECT k.doc_id, k.source, paf.doc_id IS NOT NULL OR aa.doc_id IS NOT NULL AS is_paf, aa.doc_id IS NOT NULL AS is_aa, coalesce(paf.typ, aa.typ) AS typ,
        ddo, cont, paf.typ <> aa.typ AS clash FROM k LEFT JOIN paf USING (doc_id, source) LEFT JOIN aa USING (doc_id, source)),
r AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 7 <> 0),
t AS (SELECT coalesce(r.text, '') AS text, concat_ws(',', CASE WHEN m.doc_id IS NOT NULL THEN 'Crisis financing' END, CASE WHEN is_paf THEN 'PAF' END, typ, ddo, cont,
        CASE WHEN is_aa THEN 'AA' END) AS labels FROM r FULL JOIN m USING (doc_id, source))"""


def _label_table(spark, sf):
    """Sheets out of the labels; the register lacks every seventh document."""
    d = T(spark, sf, "documents")
    s = T(spark, sf, "labels").join(d.select("doc_id", "source", "lang"), "doc_id")
    kind = F.create_map(*[F.lit(x) for kv in (("en", "Direct"), ("fr", "Indirect"), ("de", "Both"), ("es", "Part PAF")) for x in kv])
    even = F.col("doc_id") % 2 == 0
    paf = s.where("toxic = 1").select("doc_id", "source", kind[F.col("lang")].alias("type"), F.when(F.col("source").isin("src0", "src1"), "Yes").otherwise("No").alias("ddo"),
                                      F.when(F.col("doc_id") % 3 == 0, "Yes").alias("contingent"))
    aa = s.where((F.col("toxic") == 1) & even | (F.col("quality") == 1) & (F.col("doc_id") % 10 == 0)).select(
        "doc_id", "source", F.when(F.col("source") == "src0", "Both").when(even, kind[F.col("lang")]).alias("type"))
    return TR.label_table(d.where("doc_id % 7 != 0").select("doc_id", "source", "text"), s.where("quality = 1"), paf, aa, ["doc_id", "source"], ["text"],
                          "type", "type", "ddo", "contingent")


@query("label_table", LABEL_SQL + """
SELECT DISTINCT md5(text) AS text_key, CASE WHEN labels = '' THEN 'Unrelated' ELSE labels END AS labels FROM t""")
def label_table(spark, sf):
    """ML18 + PRJ12: the whole label table: implied parents, sub-types with ``Both``, deferred-drawdown and contingent labels."""
    return _label_table(spark, sf)[0].select(F.md5("text").alias("text_key"), "labels").distinct()


@query("label_conflicts", LABEL_SQL + " SELECT doc_id, source FROM m WHERE clash")
def label_conflicts(spark, sf):
    """ML18 + AST1: keys whose sub-type differs between the PAF and the AA sheet."""
    return _label_table(spark, sf)[1]


def _synthetic_explode(spark, sf, *min_len):
    c = T(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                F.when(F.length("text") > 100, "long").otherwise("short").alias("label"))
    a = c.where(F.col("role") == "assistant").join(u, ["conv_id", "turn"])
    return TR.explode_generated(a, "text", "label", *min_len, id_cols=["conv_id", "turn"]).select(
        "conv_id", "turn", "label", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("synthetic_explode", """
WITH u AS (SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS label FROM conversations WHERE role = 'user'),
a AS (SELECT c.conv_id, c.turn, u.label, c.text FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn = u.turn + 1
      WHERE c.role = 'assistant'),
e AS (SELECT conv_id, turn, label, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
             unnest(string_split(text, chr(10))) AS line FROM a)
SELECT conv_id, turn, label, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM e
WHERE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) > 10""")
def synthetic_explode(spark, sf):
    """ML19: generated responses split into lines, each inheriting the
    prompting record's label; lines of more than 10 characters."""
    return _synthetic_explode(spark, sf, 10)


@query("synthetic_explode_all", """
WITH u AS (SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS label FROM conversations WHERE role = 'user'),
a AS (SELECT c.conv_id, c.turn, u.label, c.text FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn = u.turn + 1
      WHERE c.role = 'assistant'),
e AS (SELECT conv_id, turn, label, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
             unnest(string_split(text, chr(10))) AS line FROM a)
SELECT conv_id, turn, label, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM e
WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''""")
def synthetic_explode_all(spark, sf):
    """ML19 with the operator's default: every non-blank line."""
    return _synthetic_explode(spark, sf)


@query("prompt_template", """
SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN printf('%s' || chr(10) || chr(10) || '%s',
  CASE role WHEN 'user' THEN 'Rewrite as a funding request:' ELSE 'Summarise the reply:' END, text) END AS prompt,
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'unmapped label set: ' || role END AS error
FROM conversations""")
def prompt_template(spark, sf):
    """SC18: instruction per label set from a mapping table + the text."""
    m = spark.createDataFrame([("user", "Rewrite as a funding request:"), ("assistant", "Summarise the reply:")],
                              "role string, instruction string")
    c = T(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return TR.render_template(c, m, "role").select("conv_id", "turn", "prompt", "error")


@query("evaluation_set", f"""WITH {LABELLED_SQL},
k AS (SELECT doc_id, labels FROM ld WHERE labels IN ('Unrelated', 'Crisis financing')),
u AS (SELECT doc_id, labels, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM k WHERE labels = 'Unrelated'),
h AS (SELECT doc_id, labels FROM k WHERE labels <> 'Unrelated'
      UNION ALL SELECT doc_id, labels FROM u WHERE rk <= floor((SELECT count(*) FROM u) / 2)),
r AS (SELECT doc_id, labels, row_number() OVER (PARTITION BY labels ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
             count(*) OVER (PARTITION BY labels) AS n FROM h)
SELECT doc_id, labels FROM r WHERE rk <= floor(n * 0.2)""")
def evaluation_set(spark, sf):
    """ML17: two classes, one halved, stratified 20% test rows."""
    d = labelled_docs(spark, sf).select("doc_id", "labels")
    t = TR.evaluation_set(d, None, "labels", "doc_id", ["Unrelated", "Crisis financing"], "Unrelated", 0.2, 42)
    return t.select("doc_id", "labels")


@query("csv_splits", """SELECT doc_id, md5(text) AS text_key, length(text) AS n FROM documents WHERE text <> ''""")
def csv_splits(spark, sf):
    """SRC1 + SRC6: documents written as CSV with line breaks inside fields and read back by the reader that splits files."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    IO.write_csv(T(spark, sf, "documents").where("text != ''").select("doc_id", "text"), path)
    back = CSV.read_csv_splits(spark, path, "doc_id bigint, text string")
    return back.select("doc_id", F.md5("text").alias("text_key"), F.length("text").cast("long").alias("n"))


@query("io_roundtrip", """
SELECT doc_id, lang, source, text, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang_na FROM documents""")
def io_roundtrip(spark, sf):
    """SRC1-SRC8: CSV sink + schema'd multi-line CSV scan with NA tokens,
    sheet and split-partitioned Parquet round trips, read back whole."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"
    d = T(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    IO.write_csv(d.withColumn("lang_na", F.when(F.col("lang") == "de", F.lit("#N/A")).otherwise(F.col("lang"))),
                 f"{root}/csv")
    back = IO.read_csv(spark, f"{root}/csv", "doc_id bigint, lang string, source string, text string, lang_na string")
    back = IO.null_tokens(back, ["#N/A"], ["lang_na"])
    IO.write_sheets({"docs": back}, f"{root}/sheets")
    sheet = IO.read_sheet(spark, f"{root}/sheets", "docs")
    IO.write_splits(hash_split(sheet, 0.2, "doc_id", 1), f"{root}/splits")
    return IO.read_split(spark, f"{root}/splits").drop("split")
