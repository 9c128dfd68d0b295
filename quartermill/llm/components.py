"""Connected components of an edge table, by hooking to the least neighbour, pointer jumping and contraction.

Every step is a join or a grouped minimum over tables in the shared folder: nothing of the graph reaches the driver but row
counts, no list of neighbours is collected, and a node with any number of edges is spread by partial aggregation and by
adaptive splitting of skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch


def _oriented(edges: DataFrame, scratch: Scratch) -> DataFrame:
    own = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return scratch.keep(own.distinct())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each node that isn't its component's least node; edges has columns u and v, both long.

    Self loops, repeated edges and either orientation are fine; no edges give no rows.
    """
    left = _oriented(edges, scratch)
    labels = None
    while left.take(1):
        parents = scratch.keep(left.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.keep(parents.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            scratch.drop(parents)
            parents = jumped
            if not jumped.where("moved").take(1):
                break
        if labels is None:
            labels = scratch.keep(parents.select(F.col("u").alias("node"), F.col("p").alias("root")))
        else:
            moved = labels.join(parents.select(F.col("u").alias("root"), F.col("p")), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            labels = scratch.keep(moved.unionByName(parents.select(F.col("u").alias("node"), F.col("p").alias("root"))).distinct())
        # every u has a parent; the edge joins the u's root and the v's
        parents = parents.select("u", "p")
        roots_u = scratch.keep(left.join(parents, "u").select(F.col("p").alias("ru"), "v"))
        to = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        contracted = roots_u.join(to, "v", "left").select(F.col("ru").alias("u"), F.coalesce("pv", "v").alias("v"))
        contracted = _oriented(contracted, scratch)
        scratch.drop(roots_u)
        scratch.drop(left)
        left = contracted
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return labels
