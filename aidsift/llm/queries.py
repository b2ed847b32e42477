"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aidsift.sources.tables import table

from . import (conversation, crosspolytope, decontaminate, importance, line_rules, minhash, packing, quality_pu, secret_scan, simple8b,
               substring_dedup, suffix_tree_lm, toxicity)
from .sql import ORACLES  # noqa: F401  (part of this module's interface)
from .store import shared_path

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (document, benchmark item) found: its nearest place and how many places."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    nearest = F.min(F.struct("distance", "begin", "end")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(nearest, F.count("*").alias("places")).select(
        "doc_id", "item_id", F.col("m.begin").alias("start_word"), F.col("m.end").alias("end_word"), F.col("m.distance").alias("edits"), "places")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(_fold(5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree_lm.score(table(spark, sf_dir, "documents"), _fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    simple8b.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_TOKENIZER), "byte", end_id=0)
    return simple8b.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), "word", end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(_fold(4) != 2)
    scored = quality_pu.score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds counted and hashed, and all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).alias("n_live"))


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.linked_vectors(table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's words."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of each document and whether it is kept; the host is its source."""
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's faults after damage and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return conversation.audited(rows, conversation.damaged(rows))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_suffix_tree_lm, op4_substring_dedup, op5_token_files, op6_packing,
                                   op7_quality, op8_secrets, op9_embedding_links, op10_near_duplicates, op11_importance_resampling,
                                   op12_quality_rules, op13_conversation_repair, pipeline)}

