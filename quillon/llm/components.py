"""Connected components by alternating large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_tables, shared_table


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges(u, v), u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (u, v): every linked node but the smallest of its component, with that smallest node."""
    edges = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        # the mark is one row, whatever the number of edges
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return edges
        mark, before = now, edges
        edges = shared_table(_stars(before), "edges")
        drop_tables(before.sparkSession, before)
