"""Connected components of an edge table, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import save


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the smallest node reachable, for every node that has an edge.

    Each round offers every node's parent, and the node itself, the smallest grandparent among its neighbours, then
    halves the paths; a component of n nodes takes about log n rounds. Rounds are saved tables, so a lost executor costs
    one round at most. Minima are taken before rows are exchanged, and joins follow the graph's edges, so a star with a
    third of all nodes shows only as a skewed side of a join. Loops and repeated edges do no harm; rows with a null end
    are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a != b")
    both = save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"), F.lit(True).alias("moved")), "parents")
    for _ in range(max_rounds):
        up = parents.select("node", "up")
        near = both.join(up.select(F.col("node").alias("b"), F.col("up").alias("least")), "b").groupBy("a").agg(F.min("least").alias("least"))
        known = up.join(near.withColumnRenamed("a", "node"), "node")
        offers = known.select("node", "least").unionByName(known.select(F.col("up").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("least"))
        hooked = up.join(offers, "node", "left").select("node", "up", F.least("up", F.coalesce("least", "up")).alias("new"))
        hooked = save(hooked, "hooked")
        above = hooked.select(F.col("node").alias("new"), F.col("new").alias("top"))
        parents = save(hooked.join(above, "new").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
        if parents.filter("moved").isEmpty():
            return parents.select("node", F.col("up").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
