"""Connected components of a graph given as links (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component_id`` (the smallest id reachable) of each id in ``links``.

    Alternating large-star and small-star steps: each node hands its
    neighbours the smallest id next to it, until only stars are left (no id is
    both a smaller and a larger end, or the larger end of two links). Minima
    are pre-aggregated and every step joins written tables, so a node with
    very many links is split like any other skewed join key. Links with a
    null end or of a node with itself are left out.
    """
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(a).isNotNull().alias("x"),
                         F.col(b).isNotNull().alias("y")).where("x and y and lo < hi").select("lo", "hi").distinct()
    edges = written(edges, "links")
    while not _only_stars(edges):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("w")).union(edges.select("hi", "lo"))
        low = written(both.groupBy("u").agg(F.least("u", F.min("w")).alias("m")), "star")
        large = written(both.join(low, "u").where("w > u").select(F.col("m").alias("lo"), F.col("w").alias("hi"))
                        .where("lo < hi").distinct(), "large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "star")
        small = large.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edges = written(small.union(least.select(F.col("m").alias("lo"), "hi")).distinct(), "small")
    roots = edges.select(F.col("lo").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).union(roots)


def _only_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("lo").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(
        edges.select("hi", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.max("low").alias("low"), F.sum("high").alias("high")).where("high > 1 or high + low > 1").isEmpty()
