"""Connected components of links by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the least node of its neighbourhood: the larger neighbours, or the node and the smaller ones."""
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component) for each node that has a link; the component is its least node."""
    edges = work.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        step = work.keep(_star(edges, large=True), "large")
        work.drop(edges)
        edges = work.keep(_star(step, large=False), "small")
        work.drop(step)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
