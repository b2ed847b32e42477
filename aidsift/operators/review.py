"""Review decisions and yearly sheets kept as tables (RL5, RL8).

Decisions are a change log: one row per decision, the last by time counts.
Sheets are one table partitioned by sheet and year; a run replaces just the
(sheet, year) partitions it brings, so running it again changes nothing, and a
report reads the partitions it asks for in one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge as M
from .rules import REVIEW, YES

ORIGINS = ("new", "old", "missed")


def earlier_review(auto: DataFrame, review: DataFrame, missed: DataFrame, key: str, determination: str, verdict: str = "Review",
                   positive: str = "PAF") -> DataFrame:
    """RL5, the earlier review: hits (determination Yes or Review) that the review does not list are old ones and stay; listed
    hits stay where the review says ``positive``; rows of ``auto`` that the list of missed ones names are added.

    ``auto`` with ``origin`` (new, old, missed) and the determination set to Yes. A row both kept and missed comes twice, as
    the lists are laid end to end. One pass: the lists are reduced to a row per key and looked up; a NULL key equals NULL.
    """
    listed = review.groupBy(F.col(key).alias("__k")).agg(F.bool_or(F.coalesce(F.col(verdict) == positive, F.lit(False))).alias("__yes"))
    gone = missed.select(F.col(key).alias("__m")).distinct().withColumn("__missed", F.lit(True))
    rows = auto.join(listed, auto[key].eqNullSafe(listed["__k"]), "left")
    rows = rows.join(gone, rows[key].eqNullSafe(gone["__m"]), "left")
    hit = F.coalesce(F.col(determination).isin(YES, REVIEW), F.lit(False))
    origins = F.filter(F.array(F.when(hit & F.col("__yes"), F.lit("new")), F.when(hit & F.col("__yes").isNull(), F.lit("old")),
                               F.when(F.col("__missed"), F.lit("missed"))), lambda o: o.isNotNull())
    out = rows.withColumn("origin", F.explode(origins)).withColumn(determination, F.lit(YES))
    return out.select(*auto.columns, "origin")


def review_gaps(auto: DataFrame, review: DataFrame, missed: DataFrame, key: str, determination: str) -> DataFrame:
    """AST1 for ``earlier_review``: ``list, key`` of reviewed keys that are no hit and missed keys that ``auto`` lacks (none: sound)."""
    hits = auto.where(F.col(determination).isin(YES, REVIEW)).select(key)
    bad = M.anti(review.select(key).distinct(), hits, key).select(F.lit("review").alias("list"), key)
    return bad.unionByName(M.anti(missed.select(key).distinct(), auto.select(key), key).select(F.lit("missed").alias("list"), key))


def last_decisions(log: DataFrame, key: str, at: Sequence[str], decision: str) -> DataFrame:
    """The last decision of each key by ``at``; a mergeable aggregate, so a key of any number of entries is reduced before it is shuffled."""
    return log.groupBy(key).agg(F.max_by(F.col(decision), F.struct(*at)).alias(decision))


def apply_decisions(df: DataFrame, log: DataFrame, key: str, at: Sequence[str], decision: str, drop: str) -> DataFrame:
    """``df`` without the rows whose last decision is ``drop``; rows without a decision stay, and NULL is a key."""
    gone = last_decisions(log, key, at, decision).where(F.col(decision) == drop).select(F.col(key).alias("__k"))
    return df.join(gone, df[key].eqNullSafe(gone["__k"]), "left_anti")


def write_sheets(df: DataFrame, root: str, sheet: str = "sheet", year: str = "year") -> None:
    """Replace the (sheet, year) partitions that ``df`` holds rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(sheet, year).parquet(root)


def read_sheets(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    """RL8: all sheets and years, or those that ``where`` over the partition columns asks for (pruned in the scan)."""
    out = spark.read.parquet(root)
    return out if where is None else out.where(where)
