"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terraload.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; a component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by
    doubling, and contracts the edges to the roots. Rounds grow with the logarithm of the nodes.
    Only counts reach the driver; a node with very many edges is split by the skew join, as each
    join reads written tables. Edges with a null end and loops are ignored.
    """
    edges = scratch.keep(_contracted(edges), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hooks = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                             .select("node", F.least("node", "b").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = scratch.keep(hooks.join(up, "root").select("node", F.col("above").alias("root"),
                                                                (F.col("above") != F.col("root")).alias("moved")), "hooks")
            moved = not higher.where("moved").isEmpty()
            scratch.drop(hooks)
            hooks = higher
            if not moved:
                break
        hooks_of = hooks.select(F.col("node").alias("component"), "root")
        if found is None:
            merged = scratch.keep(hooks.select("node", F.col("root").alias("component")), "found")
        else:
            merged = scratch.keep(found.join(hooks_of, "component", "left")
                                  .select("node", F.coalesce("root", "component").alias("component")), "found")
            scratch.drop(found)
        found = merged
        step = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        step = step.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        shorter = scratch.keep(_contracted(step.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        scratch.drop(edges, hooks)
        edges = shorter
    scratch.drop(edges)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    return found


def _contracted(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
