"""Stages of the pipeline on odd tables: clashing and dotted column names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aidsift.llm import secret_scan

SF = "/root/testdata/sf0.001"
NAMES = ["_spans", "_id", "_hash", "twice_id", "gone_id", "a.b", "_text_to_score", "row", "comp"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d.select("*", *[F.col("doc_id").alias(n) for n in NAMES])


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "secrets"])
def test_stages_keep_further_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema["a.b"].dataType == docs.schema["a.b"].dataType
    plain = stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = out.select("doc_id", "text", *[F.col(f"`{n}`") for n in NAMES]).collect()
    assert sorted((r[0], r[1]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
    assert all(set(r[2:]) == {r[0]} for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, docs, name):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, SF).collect() == []


def test_redacted_with_clashing_names(spark):
    rows = [(1, "password = hunter22x", "o", "en", 7, "x"), (2, None, "o", "en", 8, "y"), (None, "token: abcdef1", "p", "en", 9, "z")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "lang", "_spans", "a.b"])
    got = {r[0]: tuple(r) for r in secret_scan.redacted(docs).collect()}
    assert "hunter22x" not in got[1][1] and got[2][1] is None and "abcdef1" not in got[None][1]
    assert (got[1][4], got[1][5], got[None][4]) == (7, "x", 9)
