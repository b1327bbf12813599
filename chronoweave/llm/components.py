"""Connected components of a link table, by contraction: each round every node joins the first of its neighbours in a new hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, stash, unstash


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, root): every node that has a link, and one node that stands for all that it reaches.

    A round groups by node, with partial sums before the shuffle, then renames both ends of each link. The order is another one in
    each round, so of a chain about half the nodes stay, whatever their ids: rounds grow with the logarithm of the longest path.
    Nothing but one flag per round reaches the driver. Links to itself and repeated links change nothing; no links: no rows.
    """
    with Scratch() as s:
        both = links.where("a <> b").select("a", "b")
        edges = stash(both.union(both.select("b", "a")).distinct(), "links")
        roots, k = None, 0
        while roots is None or not edges.isEmpty():
            order = lambda node: F.struct(F.xxhash64(F.lit(k), node).alias("h"), F.col(node).alias("id"))  # noqa: E731, B023
            first: Column = F.least(order("a"), F.min(order("b")))["id"]
            parent = stash(edges.groupBy("a").agg(first.alias("up")).select(F.col("a").alias("node"), "up"), "parents")
            old = roots
            if roots is None:
                roots = stash(parent.select("node", F.col("up").alias("root")), "roots")
            else:
                step = parent.select(F.col("node").alias("root"), "up")
                roots = stash(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
            up_a = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
            up_b = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
            renamed = stash(edges.join(up_a, "a").join(up_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
            for done in (old, edges, parent):
                if done is not None:
                    unstash(done)
            edges, k = renamed, k + 1
        return s.keep(roots)
