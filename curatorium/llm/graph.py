"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.llm.store import settle


def _round(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours, then its smaller ones, to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return large.join(least, "a").select(F.inline(moved)).where(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its edges or the end of a single one."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    seen = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
    return not seen.where("leaf > 1 or (leaf = 1 and least = 0)").limit(1).count()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b) of a written table; label is the smallest node reachable.

    Star rounds go on until the edges are disjoint stars, which are the components.  Each round is written to the shared
    folder; one bit reaches the driver.  With ``rounds`` they stop there: nodes of one label are connected, but a
    component may have several.
    """
    stars, done = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), 0
    while done != rounds:
        stars, done = settle(_round(stars), "edges"), done + 1
        if rounds is None and _are_stars(stars):
            break
    leaves = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return leaves.unionByName(stars.select(F.col("b").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti").withColumn("label", F.col("node")))
