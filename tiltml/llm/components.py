"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltml.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u, v)``: pairs of longs, any direction, repeats and loops allowed. Returns
    ``(node, root)`` for every node that has a link to another one and isn't its component's
    smallest node; root is that smallest one.

    Every step is a minimum by node (combined before the shuffle) and a join on the node, so a node
    with very many neighbours is no group in one task: the join's large side is split. Each
    round is written to the shared folder, which cuts the lineage; rounds grow with the logarithm of
    the longest path, not with the number of nodes.
    """
    edges = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
