"""Random walks over a pattern (wander join), all walks of a run at once as a DataFrame.

A walk starts at a random edge, extends by a random neighbour along each further edge, and counts with the inverse of its
probability; edges that close a cycle multiply by the number of parallel edges.  Random choices are hashes of seed, walk
and step, so a task that runs again repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import VID, Graph, GraphFault
from ..operators.patterns import Pattern, filtered_edges, filtered_vertices
from ..scratch import written


def walk_order(p: Pattern, first: int) -> list[tuple[int, str, int, int]]:
    """The pattern's edges from one on, each touching an earlier one."""
    left = [p.edges[first], *[e for i, e in enumerate(p.edges) if i != first]]
    out, bound = [left.pop(0)], set()
    bound |= set(out[0][2:])
    while left:
        e = next((x for x in left if bound & set(x[2:])), None)
        if e is None:
            raise GraphFault("the pattern isn't connected")
        left.remove(e)
        out.append(e)
        bound |= set(e[2:])
    return out


def _draw(seed: int, step: int, n: Column) -> Column:
    """A number below n for each walk."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.col("walk")), n)


#: Neighbours of a vertex that are numbered together.
PART = 4096


def _extended(df: DataFrame, near: DataFrame, x: str, y: str, seed: int, step: int) -> DataFrame:
    """Walks with a random neighbour y of x.

    The neighbours of a vertex are dealt into parts of some PART by a hash; a part is drawn, then a neighbour in it, and the
    weight grows by parts times the part's size.  So no vertex, whatever its degree, is sorted in one task.
    """
    parts = near.groupBy(x).agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = near.join(parts, x).withColumn("part", F.pmod(F.xxhash64(y), F.col("parts")))
    sizes = dealt.groupBy(x, "part").agg(F.count("*").alias("k"))
    numbered = dealt.withColumn("pick", F.row_number().over(Window.partitionBy(x, "part").orderBy(y)).cast("long") - 1).select(x, "part", "pick", y)
    drawn = df.join(parts, x).withColumn("part", _draw(seed, 2 * step, F.col("parts"))).join(sizes, [x, "part"]).withColumn("pick", _draw(seed, 2 * step + 1, F.col("k")))
    return drawn.join(numbered, [x, "part", "pick"]).withColumn("weight", F.col("weight") * F.col("k") * F.col("parts")).drop("k", "pick", "part", "parts")


def walks(g: Graph, p: Pattern, order: list[tuple[int, str, int, int]], share: float, seed: int) -> DataFrame:
    """(walk, weight): a walk from each edge of a random share of the first edges; its weight is the product of the degrees
    on its way, 0 where it ended early.  The mean weight times the number of first edges estimates the count."""
    a, b = order[0][2:]
    first = filtered_edges(g, p, order[0])
    if share < 1:
        first = first.where(F.pmod(F.xxhash64(F.lit(seed), "s", "d"), F.lit(1 << 20)) < int(share * (1 << 20)))
    if a == b:
        first = first.where("s = d")
    starts = written(first.select(F.col("s").alias(f"v{a}"), *([F.col("d").alias(f"v{b}")] if a != b else [])), "walk-starts")
    df = starts.withColumn("walk", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0))
    everyone = df.select("walk")
    bound = set(order[0][2:])
    for step, e in enumerate(order[1:], 1):
        _, _, a, b = e
        edges = filtered_edges(g, p, e)
        if a in bound and b in bound:
            ways = edges.groupBy(F.col("s").alias(f"v{a}"), F.col("d").alias(f"v{b}")).agg(F.count("*").alias("k")) if a != b else edges.where("s = d").groupBy(F.col("s").alias(f"v{a}")).agg(F.count("*").alias("k"))
            df = df.join(ways, [f"v{a}", f"v{b}"] if a != b else [f"v{a}"]).withColumn("weight", F.col("weight") * F.col("k")).drop("k")
            continue
        here, there, x, y = ("s", "d", a, b) if a in bound else ("d", "s", b, a)
        near = edges.select(F.col(here).alias(f"v{x}"), F.col(there).alias(f"v{y}"))
        df = _extended(df, near, f"v{x}", f"v{y}", seed, step)
        bound.add(y)
    for v in p.vertices:
        if p.of("vertex", v):
            df = df.join(filtered_vertices(g, p, v).select(F.col(VID).alias(f"v{v}")), f"v{v}", "left_semi")
    done = df.select("walk", "weight")
    return everyone.join(done, "walk", "left").select("walk", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def wander_join(g: Graph, p: Pattern, ratio: float, seed: int = 0, iterations: int = 1) -> float:
    """The mean of inverse probabilities over the walks, and over iterations with seed + i.

    As many walks as the share `ratio` of the mean table size.  Each plan (first edge) is tried on a few of them; the one
    with the least variance times lookups takes the rest.
    """
    sizes = [filtered_edges(g, p, e).count() for e in p.edges]
    n = max(1, int(sum(sizes) / len(sizes) * ratio))
    orders = [walk_order(p, i) for i in range(len(p.edges))]
    of = lambda o: max(1, sizes[p.edges.index(o[0])])
    best = orders[0]
    if len(orders) > 1:
        costs = []
        for i, o in enumerate(orders):
            r = walks(g, p, o, min(1.0, max(50, n // 20) / of(o)), seed).agg(F.var_pop("weight").alias("v"), F.count_if(F.col("weight") > 0).alias("hits")).first()
            costs.append(((r["v"] or 0.0) * of(o) ** 2 * len(o) if r["hits"] else float("inf"), i))
        best = orders[min(costs)[1]]
    total = 0.0
    for i in range(iterations):
        mean = walks(g, p, best, min(1.0, n / of(best)), seed + i).agg(F.avg("weight").alias("m")).first()["m"] or 0.0
        total += mean * sizes[p.edges.index(best[0])]
    return total / iterations
