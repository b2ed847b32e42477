"""From raw documents to packed training sequences.

Each stage works on what its predecessor kept and, but for the last, returns
the columns of ``documents``. Stages are written as Parquet into the folder
named by ``spark.checkpoint.dir`` and read again.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aidsift.llm import decontaminate, minhash, packing, secret_scan, toxicity
from aidsift.llm.queries import WORD_TOKENIZER
from aidsift.llm.store import shared_path
from aidsift.sources.tables import table


#: The columns that stages read or set; all others pass through under names that no operator uses.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _any_columns(stage):
    """The stage on ``docs`` with further columns renamed for its time, so that no name clashes or needs quoting."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)
    return run


@_any_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts stay; repeated rows and very
    long texts are scored row by row and whole."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@_any_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, and
    of rows equal in id and text one. Documents without words are not duplicates."""
    found = minhash.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id"))
    once = kept.join(twice, kept["doc_id"] == twice["twice_id"], "left")
    columns = [F.col(c) for c in docs.columns]
    single = once.where("twice_id is null").select(*columns)
    return single.union(once.where("twice_id is not null").select(*columns).dropDuplicates(["doc_id", "text"]))


@_any_columns
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows each on its own; null and empty texts stay. Texts are
    searched whole."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


@_any_columns
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are replaced; documents stay, ``n_chars`` follows the text. Null texts stay null;
    rows that share an id are redacted by the spans of their own text."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids. A null text is an empty document; repeated rows
    are packed each; further columns are not read."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER), "word", end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The learnt stages and the tokenizer are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
