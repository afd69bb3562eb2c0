"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import kept, release


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node in edges (a, b): two nodes have the same root exactly if a path joins them.

    Each round moves every node to its least neighbour, or itself, and keeps the edges between different
    targets; an edge's ends stay joined, so no connection is lost. Nodes are expected to be hashes: with
    their random order each round leaves a fraction of the nodes. Rounds are written to the shared folder.
    Edges with a null end are ignored; repeated edges and loops do no harm; no edges give no rows.
    """
    live = kept(edges.select("a", "b").where("a is not null and b is not null and a != b").distinct())
    moved = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        ends = live.join(step.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        before, live = live, kept(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(before)
        if moved is None:
            moved = step
        else:
            before, moved = moved, kept(moved.withColumnRenamed("root", "mid").join(step.withColumnsRenamed({"node": "mid"}), "mid", "left").select("node", F.coalesce("root", "mid").alias("root")))
            release(before, step)
    return moved if moved is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
