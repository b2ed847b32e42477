"""Shared pieces of the driver queries: table access, the engine-neutral
text normaliser in both dialects, and the literal dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..sources.tables import table as T  # noqa: F401


def norm(c):
    """Spark side of the cross-engine normaliser (lower, non [a-z0-9] -> blank)."""
    return norm_text(c, punct="ascii")


def norm_sql(c: str) -> str:
    """DuckDB side of ``norm``."""
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def padded_any_sql(c: str, words) -> str:
    """Whole-token test in SQL on normalised text ``c``."""
    ws = sorted(set(words))
    if not ws:
        return "false"
    return "(" + " OR ".join(f"contains(' ' || {c} || ' ', ' {w} ')" for w in ws) + ")"


def r6(c):
    return F.round(c, 6)


def lit_rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values_sql(rows, cols) -> str:
    """Literal rows as a DuckDB VALUES relation."""
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


# --- label lists derived from ``labels`` (stand-in for the labelled sheets):
# quality -> "Crisis financing", toxic -> "PAF", both -> "AA", none -> "Unrelated"
LABEL_VOCAB = ["Crisis financing", "PAF", "AA"]


def label_list(quality="quality", toxic="toxic"):
    q, t = F.col(quality), F.col(toxic)
    s = F.concat_ws(",", F.when(q == 1, F.lit("Crisis financing")),
                    F.when(t == 1, F.lit("PAF")), F.when((q == 1) & (t == 1), F.lit("AA")))
    return F.when(s == "", F.lit("Unrelated")).otherwise(s)


LABEL_LIST_SQL = """CASE WHEN concat_ws(',', CASE WHEN quality = 1 THEN 'Crisis financing' END,
    CASE WHEN toxic = 1 THEN 'PAF' END, CASE WHEN quality = 1 AND toxic = 1 THEN 'AA' END) = ''
  THEN 'Unrelated' ELSE concat_ws(',', CASE WHEN quality = 1 THEN 'Crisis financing' END,
    CASE WHEN toxic = 1 THEN 'PAF' END, CASE WHEN quality = 1 AND toxic = 1 THEN 'AA' END) END"""


def labelled_docs(spark, sf):
    """documents that carry labels, with the derived label list."""
    d = T(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.join(T(spark, sf, "labels"), "doc_id").withColumn("labels", label_list())


LABELLED_SQL = f"""ld AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  {LABEL_LIST_SQL} AS labels FROM documents d JOIN labels l USING (doc_id))"""
