"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.base import cut, drop_cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (smallest node reachable) of every node of ``edges`` (a, b: longs); a written table.

    Stars are built around smallest neighbours and shortened until nothing changes, a logarithmic number of rounds:
    each node's larger neighbours move to its smallest one, then its smaller ones do.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = cut(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    before = None
    for _ in range(most):
        # large star: over both directions, the smallest of a node and its neighbours gets the larger neighbours
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large")
        # small star: a node and its smaller neighbours get the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.distinct(), "small")
        drop_cut(last, large)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = cut(nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")
    drop_cut(nodes, e)
    return found
