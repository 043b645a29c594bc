"""Connected components by alternating large-star and small-star steps on distributed edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) pairs with a > b: neighbours move to the least node they can see from here."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")))
    seen = both.join(least, "a").withColumn("m", F.least("a", "m"))
    if large:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node points to two others, or to one and is pointed to. Counts combine on the map side."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
    return nodes.agg(F.max(F.expr("out > 1 or (out = 1 and least = 0)"))).first()[0] or False


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of `edges` (long columns a, b) that isn't the least of its component, with that least node."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while _unfinished(edges):
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
    return edges
