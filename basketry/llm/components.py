"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch


def _toward_minimum(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _flatten(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low).distinct()


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` that is not itself its component's smallest node.

    Edges stay a table throughout: minima are partial aggregates and the joins are on plain
    keys, so a hub of any degree is spread by skew-join splitting.  Each round is written to
    the shared folder, which cuts the lineage and survives lost executors.  Self links and
    repeated links are allowed; an empty table gives an empty result.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges, path = scratch.pin(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .filter("a != b").distinct())
    for _ in range(rounds):
        # A forest of stars: no root is a leaf and every leaf has one root.
        many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        unsettled = many.filter("n > 1").select("a").union(
            edges.join(edges.select(F.col("a").alias("leaf")), F.col("b") == F.col("leaf"), "left_semi").select("a"))
        if unsettled.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        new, new_path = scratch.pin(_flatten(_toward_minimum(edges)))
        scratch.drop(path)
        edges, path = new, new_path
    raise RuntimeError(f"components did not settle in {rounds} rounds")
