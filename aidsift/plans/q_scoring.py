"""Chunked scoring, cascades and ensembles (ML1-ML5, ML11, AG15, SC21-SC24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import scoring as S
from .common import T, norm, r6
from .registry import query

LABELS = ["Crisis finance", "PAF", "AA"]
# an arithmetic stand-in model: letter frequencies -> logits -> sigmoid
FEATURES = {"Crisis finance": ("e", 0.10), "PAF": ("a", 0.08), "AA": ("t", 0.07)}


def _freq(c, ch):
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) / F.greatest(F.length(c), F.lit(1))


def letter_scorer(c):
    return {l: N.sigmoid(F.lit(40.0) * (_freq(c, ch) - F.lit(b))) for l, (ch, b) in FEATURES.items()}


def _freq_sql(c, ch):
    return f"((length({c}) - length(replace({c}, '{ch}', ''))) / greatest(length({c}), 1))"


def _conf_sql(c, label):
    ch, b = FEATURES[label]
    return f"(1.0 / (1.0 + exp(-(40.0 * ({_freq_sql(c, ch)} - {b})))))"


def chunk_sql(src: str = "documents", text: str = "text", name: str = "chunks") -> str:
    """Balanced whitespace chunking in DuckDB (the oracle of ``chunk``)."""
    return f"""{name}_t AS (
  SELECT doc_id, toks, n, CASE WHEN n <= 512 THEN n ELSE CAST(ceil(n / ceil(n / 512)) AS INTEGER) END AS size
  FROM (SELECT doc_id, string_split({text}, ' ') AS toks, len(string_split({text}, ' ')) AS n FROM {src})),
{name} AS (
  SELECT doc_id, CAST(s / size AS INTEGER) AS chunk_no,
         array_to_string(list_slice(toks, s + 1, s + size), ' ') AS chunk
  FROM (SELECT doc_id, toks, size, unnest(range(0, n, size)) AS s FROM {name}_t))"""


CHUNK_SQL = chunk_sql()


@query("chunk_docs", f"""WITH {CHUNK_SQL}
SELECT doc_id, chunk_no, len(string_split(chunk, ' ')) AS n_tokens, length(chunk) AS chunk_chars FROM chunks""")
def chunk_docs(spark, sf):
    """ML1 / UD6: balanced 512-token chunks of whole documents."""
    c = S.chunk(T(spark, sf, "documents").select("doc_id", "text"), "text", 512)
    return c.select("doc_id", "chunk_no", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.length("chunk").cast("bigint").alias("chunk_chars"))


def _doc_sql(src, labels, gate=False, th=None):
    th = th or {}
    cols = []
    for l in labels:
        k = l.split()[0].lower()
        cols.append(f"coalesce(bool_or(c_{k} > 0.5 AND c_{k} > {th.get(l, 0.0)}), false) AS p_{k}, "
                    f"round(coalesce(max(c_{k}), 0), 6) AS c_{k}")
    return ", ".join(cols)


SCORED_SQL = f"""{CHUNK_SQL},
sc AS (SELECT doc_id, chunk_no, {_conf_sql('chunk', 'Crisis finance')} AS c_crisis,
  {_conf_sql('chunk', 'PAF')} AS c_paf, {_conf_sql('chunk', 'AA')} AS c_aa FROM chunks)"""


def _rename_docs(df):
    out = []
    for l in LABELS:
        k = l.split()[0].lower()
        out += [F.col(f"`{l} predicted`").alias(f"p_{k}"), r6(F.col(f"`{l} confidence`")).alias(f"c_{k}")]
    return df.select("doc_id", *out)


@query("chunk_aggregate", f"""WITH {SCORED_SQL}
SELECT doc_id, {_doc_sql(None, LABELS)} FROM sc GROUP BY doc_id""")
def chunk_aggregate(spark, sf):
    """ML2 + AG15 + JN20: score every chunk, fold to documents by id."""
    d = T(spark, sf, "documents").select("doc_id", "text")
    return _rename_docs(S.score_documents(d, "doc_id", "text", letter_scorer, LABELS))


@query("cascade_chunk", f"""WITH {SCORED_SQL},
g AS (SELECT doc_id, c_crisis, CASE WHEN c_crisis > 0.5 THEN c_paf ELSE 0.0 END AS c_paf0,
        CASE WHEN c_crisis > 0.5 AND c_paf > 0.5 THEN c_aa ELSE 0.0 END AS c_aa0 FROM sc),
g2 AS (SELECT doc_id, c_crisis, c_paf0 AS c_paf, c_aa0 AS c_aa FROM g)
SELECT doc_id, {_doc_sql(None, LABELS, th={'PAF': 0.6})} FROM g2 GROUP BY doc_id""")
def cascade_chunk(spark, sf):
    """ML3 + ML5: chunk-gated cascade CF -> PAF -> AA, PAF minimum confidence 0.6."""
    d = T(spark, sf, "documents").select("doc_id", "text")
    stages = [(l, letter_scorer) for l in LABELS]
    return _rename_docs(S.cascade_chunk(d, "doc_id", "text", stages, {"PAF": 0.6}))


def _limited():
    lines = F.split(F.col("text"), "\n")
    return F.concat_ws(" ", F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2)))


def _cascade_sql(limited: str) -> str:
    """PAF where the document's CF holds; AA where the chunk's PAF does."""
    return f"""WITH {SCORED_SQL},
d1 AS (SELECT doc_id, coalesce(bool_or(c_crisis > 0.5), false) AS p_crisis, coalesce(max(c_crisis), 0) AS c_crisis
       FROM sc GROUP BY doc_id),
lim AS (SELECT doc_id, {limited} AS lt FROM documents WHERE doc_id IN (SELECT doc_id FROM d1 WHERE p_crisis)),
{chunk_sql('lim', 'lt', 'lc')},
s2 AS (SELECT doc_id, chunk, {_conf_sql('chunk', 'PAF')} AS paf FROM lc),
s3 AS (SELECT doc_id, paf, CASE WHEN paf > 0.5 THEN {_conf_sql('chunk', 'AA')} ELSE 0.0 END AS aa FROM s2),
d3 AS (SELECT doc_id, bool_or(paf > 0.5 AND paf > 0.6) AS p_paf, max(paf) AS c_paf, bool_or(aa > 0.5) AS p_aa, max(aa) AS c_aa FROM s3 GROUP BY doc_id)
SELECT d1.doc_id, d1.p_crisis, round(d1.c_crisis, 6) AS c_crisis, coalesce(d3.p_paf, false) AS p_paf, round(coalesce(d3.c_paf, 0), 6) AS c_paf,
       coalesce(d3.p_aa, false) AS p_aa, round(coalesce(d3.c_aa, 0), 6) AS c_aa FROM d1 LEFT JOIN d3 USING (doc_id)"""


def _cascade(spark, sf, limited):
    d = T(spark, sf, "documents").select("doc_id", "text", limited.alias("limited"))
    stages = [("Crisis finance", "text", letter_scorer), ("PAF", "limited", letter_scorer),
              ("AA", "limited", letter_scorer)]
    return _rename_docs(S.cascade_doc(d, "doc_id", stages, {"PAF": 0.6}))


@query("cascade_doc", _cascade_sql("concat_ws(' ', string_split(text, chr(10))[1], string_split(text, chr(10))[2])"))
def cascade_doc(spark, sf):
    """ML4: document-gated cascade; CF on the full text, PAF and AA on the
    limited text (first two lines) of documents the first stage kept, AA on
    chunks that PAF predicted, PAF minimum confidence 0.6."""
    return _cascade(spark, sf, _limited())


@query("cascade_doc_chunks", _cascade_sql("array_to_string(string_split(text, chr(10))[2:], ' ')"))
def cascade_doc_chunks(spark, sf):
    """ML4 with limited texts of many chunks: all lines but the first."""
    lines = F.split(F.col("text"), "\n")
    return _cascade(spark, sf, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " "))


def _joint_frame(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "text")
    a = S.score_documents(d, "doc_id", "text", letter_scorer, LABELS)
    b = {l: N.sigmoid(F.lit(40.0) * (_freq(F.col("text"), ch) - F.lit(bb + 0.01))) for l, (ch, bb) in FEATURES.items()}
    return a.withColumns({f"{l} confidence XGB": v for l, v in b.items()})


@query("joint_ensemble", f"""WITH {SCORED_SQL},
a AS (SELECT doc_id, coalesce(max(c_crisis), 0) AS a_cf, coalesce(max(c_paf), 0) AS a_paf, coalesce(max(c_aa), 0) AS a_aa
      FROM sc GROUP BY doc_id),
b AS (SELECT doc_id, {_conf_sql('text', 'Crisis finance').replace(' - 0.1)', ' - 0.11)')} AS b_cf,
      {_conf_sql('text', 'PAF').replace(' - 0.08)', ' - 0.09)')} AS b_paf,
      {_conf_sql('text', 'AA').replace(' - 0.07)', ' - 0.08)')} AS b_aa FROM documents),
j AS (SELECT doc_id,
  CASE WHEN least(a_cf, 1 - a_cf) <= least(b_cf, 1 - b_cf) THEN a_cf ELSE b_cf END AS j_cf,
  CASE WHEN least(a_paf, 1 - a_paf) <= least(b_paf, 1 - b_paf) THEN a_paf ELSE b_paf END AS j_paf,
  CASE WHEN least(a_aa, 1 - a_aa) <= least(b_aa, 1 - b_aa) THEN a_aa ELSE b_aa END AS j_aa FROM a JOIN b USING (doc_id)),
j2 AS (SELECT doc_id, j_cf, CASE WHEN j_aa < 0.5 THEN j_paf ELSE j_aa END AS j_paf, j_aa FROM j),
j3 AS (SELECT doc_id, CASE WHEN j_paf < 0.5 THEN j_cf ELSE j_paf END AS j_cf, j_paf, j_aa FROM j2)
SELECT doc_id, round(j_cf, 6) AS c_crisis, j_cf >= 0.5 AS p_crisis, round(j_paf, 6) AS c_paf, j_paf >= 0.5 AS p_paf,
       round(j_aa, 6) AS c_aa, j_aa >= 0.5 AS p_aa FROM j3""")
def joint_ensemble(spark, sf):
    """ML11 + SC22-SC24: most-confident of two models per label, AA -> PAF -> CF
    propagation, ``>= 0.5`` predictions."""
    j = S.joint(_joint_frame(spark, sf), LABELS)
    out = []
    for l in LABELS:
        k = l.split()[0].lower()
        out += [r6(F.col(f"`{l} confidence joint`")).alias(f"c_{k}"), F.col(f"`{l} predicted joint`").alias(f"p_{k}")]
    return j.select("doc_id", *out)


@query("propagate_conf", f"""WITH {SCORED_SQL},
a AS (SELECT doc_id, coalesce(bool_or(c_crisis > 0.5), false) AS p_cf, coalesce(max(c_crisis), 0) AS c_cf,
             coalesce(bool_or(c_paf > 0.5), false) AS p_paf, coalesce(max(c_paf), 0) AS c_paf,
             coalesce(bool_or(c_aa > 0.5), false) AS p_aa, coalesce(max(c_aa), 0) AS c_aa FROM sc GROUP BY doc_id),
b AS (SELECT doc_id, p_cf, c_cf, p_paf OR p_aa AS p_paf2, CASE WHEN p_aa AND NOT p_paf THEN c_aa ELSE c_paf END AS c_paf2, p_aa, c_aa FROM a)
SELECT doc_id, p_cf OR p_paf2 AS p_crisis, round(CASE WHEN p_paf2 AND NOT p_cf THEN c_paf2 ELSE c_cf END, 6) AS c_crisis,
       p_paf2 AS p_paf, round(c_paf2, 6) AS c_paf FROM b""")
def propagate_conf(spark, sf):
    """SC24 (flag form): a predicted child sets its parent and lifts its confidence."""
    d = T(spark, sf, "documents").select("doc_id", "text")
    s = S.score_documents(d, "doc_id", "text", letter_scorer, LABELS)
    chain = [(f"{l} predicted", f"{l} confidence") for l in reversed(LABELS)]
    s = N.propagate_flags(s, chain)
    return s.select("doc_id", F.col("`Crisis finance predicted`").alias("p_crisis"),
                    r6(F.col("`Crisis finance confidence`")).alias("c_crisis"),
                    F.col("`PAF predicted`").alias("p_paf"), r6(F.col("`PAF confidence`")).alias("c_paf"))


@query("softmax_argmax", """
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top,
  round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x - list_max(embedding)))), 6) AS p_top
FROM embeddings""")
def softmax_argmax(spark, sf):
    """SC21: softmax over a vector, argmax and its probability."""
    e = T(spark, sf, "embeddings")
    sm = N.softmax(F.col("embedding"))
    return e.select("vec_id", N.argmax("embedding").alias("top"), r6(F.array_max(sm)).alias("p_top"))


@query("score_batches", """SELECT doc_id, true AS agrees, len(text) > 0 AS has_text FROM documents""")
def score_batches(spark, sf):
    """ML2 + ML14 + UD3: a word model fitted on labelled documents scores every document's chunks in Arrow batches; ``agrees``
    says that predictions and confidences are those of the same model as a column expression."""
    d = T(spark, sf, "documents").select("doc_id", norm("text").alias("t"))
    lab = T(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("good"), F.col("toxic").cast("double").alias("bad"))
    model = S.fit_word_model(d.join(lab, "doc_id"), "t", ["good", "bad"], words=200)
    a = S.score_pandas(d, "t", lambda: model, ["good", "bad"], max_tokens=128)
    both = S.score_documents(a.withColumnsRenamed({"good predicted": "pg", "good confidence": "cg", "bad predicted": "pb", "bad confidence": "cb"}),
                             "doc_id", "t", model.column(["good", "bad"]), ["good", "bad"], max_tokens=128)
    near = (F.abs(F.col("cg") - F.col("good confidence")) < 1e-9) & (F.abs(F.col("cb") - F.col("bad confidence")) < 1e-9)
    same = (F.col("pg") == F.col("good predicted")) & (F.col("pb") == F.col("bad predicted"))
    return both.select("doc_id", (near & same & F.col("cg").between(0.0, 1.0)).alias("agrees"), (F.length("t") > 0).alias("has_text"))
