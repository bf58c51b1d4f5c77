"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.io import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b), two longs; the component is its smallest node.

    Loops and repeated edges change nothing; no edges give no rows. The rounds are logarithmic in the
    longest chain; each ends in a checkpoint, and they end when no upper end of an edge is a lower one.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), small=True)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low.hint("shuffle_hash"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Every edge points down now: the small star of a node joins it and its lower neighbours to the lowest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low.hint("shuffle_hash"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.filter("a <> b").distinct(), small=True)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every edge leads from a node to the lowest of its component: none has two ends below, none is an end and a start."""
    roles = e.select(F.col("a").alias("v"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    worst = roles.groupBy("v").agg(F.sum("above").alias("above"), F.max("below").alias("below")).filter("above > 1 or (above > 0 and below > 0)")
    return worst.isEmpty()
