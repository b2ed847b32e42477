"""Keyword tables of any size (JN18).

``keyword_flags`` joins texts with a keyword table instead of putting the
keywords into a plan: each keyword is keyed by its rarest token, each token of a
text brings the few tokens around it, an equi-join on the token makes the candidates, and
the tokens around verify the keyword in its place. A table that provably fits
is broadcast, so tokens and what is around them are never shuffled; beyond that the
keywords never reach the driver, and a frequent token is spread over salts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..session import cut_lineage, sized_broadcast
from .rules import LABEL_FAMILIES, words_only

SALTS = 8
BROADCAST_ROWS = 1_000_000


def keyword_flags(df: DataFrame, id_col: str, text: str, keywords: DataFrame, keyword: str = "keyword", category: str = "category",
                  families: Mapping[str, Sequence[str]] = LABEL_FAMILIES, suffix: str = " keyword match", punct: str = "word") -> DataFrame:
    """``id_col`` and one boolean per label family for each row: does its normalised ``text`` hold a keyword of the family as whole tokens?

    Keywords are normalised here like the text; those without tokens match nothing. Rows that share an id (null is an
    id) share their flags. The result has no text: join it to what else is needed.
    """
    kw = keywords.select(F.split(words_only(norm_text(F.col(keyword), punct), punct), " ").alias("kw"), F.col(category).alias("category"))
    kw = kw.where("kw[0] != ''").distinct()
    longest = kw.agg(F.coalesce(F.max(F.size("kw")), F.lit(1)).alias("n")).first()["n"]
    toks = F.split(words_only(F.col(text), punct), " ")
    rows = df.select(F.col(id_col).alias("id"), toks.alias("toks")).where(F.col(text).isNotNull())

    def around(token, i):
        """A token, its place (from 1) among the tokens kept around it, and those."""
        first = F.greatest(i - (longest - 2), F.lit(1))
        return F.struct(token.alias("token"), (i + 2 - first).alias("at"), F.slice("toks", first, F.lit(2 * longest - 1)).alias("near"))

    parts = kw.select("kw", "category", F.posexplode("kw").alias("offset", "token"))
    wanted = sized_broadcast(parts.select("token").distinct(), BROADCAST_ROWS)
    frequency = rows.select(F.explode("toks").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    anchored = parts.join(frequency, "token", "left").groupBy("kw", "category").agg(
        F.min_by(F.struct("token", "offset"), F.struct("n", "token", "offset")).alias("a"), F.count_if(F.col("n").isNull()).alias("absent"))
    anchored = cut_lineage(anchored.where("absent = 0").select("kw", "category", "a.*"))
    held = rows.select("id", F.explode(F.transform("toks", around)).alias("t")).select("id", "t.*")
    few = sized_broadcast(anchored, BROADCAST_ROWS)
    if few is not anchored:
        met = held.join(few, "token")
    else:
        salted = anchored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    first = F.col("at") - F.col("offset")
    found = met.where(
        (first >= 1) & (F.slice("near", F.greatest(first, F.lit(1)), F.size("kw")) == F.col("kw"))).select("id", "category").distinct()
    flags = found.groupBy("id").agg(*[F.bool_or(F.col("category").isin(list(cats))).alias(name) for name, cats in families.items()])
    ids = df.select(F.col(id_col).alias("__id"))
    out = ids.join(flags, ids["__id"].eqNullSafe(flags["id"]), "left")
    return out.select(F.col("__id").alias(id_col), *[F.coalesce(name, F.lit(False)).alias(name + suffix) for name in families])
