"""Connected components of undirected links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrows import checkpointed


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links every larger neighbour of a node to the smallest node around it.

    Small star: links every smaller neighbour, and the node, to the smallest of them. Edges hold
    u > v. The smallest neighbours are written down before they are joined, so that a node with
    very many links is split among tasks.
    """
    sides = edges.select("u", "v")
    if large:
        sides = sides.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = sides.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return checkpointed(moved.where("u <> v").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """A row (node, component) for every node of links (a, b) that is not the smallest of its
    component; component is the smallest node reachable.

    Rounds grow with the logarithm of the links; each is cut off by a checkpoint. Links of a node
    to itself and repeated links change nothing; links with a null end are ignored.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = _starred(_starred(edges, large=True), large=False)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
