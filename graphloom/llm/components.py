"""Connected components of an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour where that is smaller, follows the pointers to their ends, and
    contracts the edges; at least half of the nodes with edges go in a round.  Tables stay distributed, joins have a plain
    exchange on both sides so that hot nodes can be split, and each step is written, so recovery is short.
    """
    left = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            up = materialise(up.join(over, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "jumps")
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = materialise(found.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialise(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
