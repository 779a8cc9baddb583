"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, comp)`` for every id in ``edges(a, b)``: the smallest id reachable from it.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots, and contracts the
    graph to one node per root, so the number of nodes at least halves. A hub with any number of neighbours costs
    one partially aggregated row per task; no neighbour list is ever built. Self-loops, repeated and reversed
    edges are harmless; rows with a null end are ignored; no edges give an empty table.
    """
    work = scratch.keep(
        edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while labels is None or not work.isEmpty():
        both = work.select(F.col("a").alias("u"), F.col("b").alias("v")).union(work.select("b", "a"))
        parent = scratch.keep(
            both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "hook"
        )
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = scratch.keep(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
            scratch.drop(parent)
            still, parent = not jumped.where("moved").isEmpty(), jumped
            if not still:
                break
        roots = parent.select("u", "p")
        if labels is None:
            nxt = roots.select(F.col("u").alias("id"), F.col("p").alias("comp"))
            labels = scratch.keep(nxt, "labels")
        else:
            merged = labels.join(roots, labels.comp == roots.u, "left").select("id", F.coalesce("p", "comp").alias("comp"))
            old, labels = labels, scratch.keep(merged, "labels")
            scratch.drop(old)
        ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        smaller = work.join(ra, "a").join(rb, "b").where("ra <> rb")
        smaller = smaller.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, work = work, scratch.keep(smaller, "edges")
        scratch.drop(old, parent)
    scratch.drop(work)
    return labels
