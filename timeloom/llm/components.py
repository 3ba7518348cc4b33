"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as longs -> a written table (id, component), component being the smallest id that is reachable.

    Large and small stars in turn: every round links a node's neighbours to the smallest one, so that paths
    shrink to stars in a number of rounds logarithmic in the nodes. Each round is written to the shared folder, and the one
    before it deleted; only whether all edges are stars yet reaches the driver. A hot node's edges are joined with a table, and
    so are split at run time.
    """
    with Workspace(edges.sparkSession) as w:
        held = w.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        while not _are_stars(held):
            both = held.select("a", "b").unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = w.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
            large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            own = least.filter("m < a").select("a", F.col("m").alias("b"))
            large = w.write(large.unionByName(own).filter("a <> b").distinct(), "large-star")
            w.free(held, least)
            least = w.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            own = least.select("a", F.col("m").alias("b"))
            held = w.write(small.unionByName(own).filter("a <> b").distinct(), "small-star")
            w.free(large, least)
        roots = held.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
        out = w.write(held.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots), "components")
        return w.result(out, out)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none both up and down."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("v").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()
