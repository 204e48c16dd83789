"""Pattern statistics: degrees, degree histograms, exact counts of tree patterns, column statistics.

Everything is a join with edges and a sum by vertex; no match is enumerated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import DST, SRC, VID, Graph, GraphFault


@dataclass
class Pattern:
    """A query graph: vertices {id: label}, edges (id, label, src, dst), predicates by element."""

    vertices: dict[int, str]
    edges: list[tuple[int, str, int, int]]
    predicates: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, data: dict) -> Pattern:
        vertices: dict[int, str] = {}
        for v in data["vertices"]:
            if v["id"] in vertices:
                raise GraphFault(f"vertex {v['id']} occurs twice")
            vertices[v["id"]] = v["label"]
        edges = [(e["id"], e["label"], e["src"], e["dst"]) for e in data["edges"]]
        if len({e[0] for e in edges}) != len(edges):
            raise GraphFault("an edge id occurs twice")
        if any(x not in vertices for e in edges for x in e[2:]):
            raise GraphFault("an edge has an unknown end")
        predicates = list(data.get("predicates") or [])
        for p in predicates:
            check_predicate(p)
        return cls(vertices, edges, predicates)

    def of(self, target: str, key: int) -> list[dict]:
        return [p for p in self.predicates if p["target"].lower() == target and p["id"] == key]

    def is_tree(self) -> bool:
        reached, todo = set(), [next(iter(self.vertices))]
        while todo:
            v = todo.pop()
            if v not in reached:
                reached.add(v)
                todo += [b if a == v else a for _, _, a, b in self.edges if v in (a, b)]
        return reached == set(self.vertices) and len(self.edges) == len(self.vertices) - 1


def scalar(v: object) -> object:
    """A literal, plain or tagged with its type."""
    if isinstance(v, dict):
        v = next(iter(v.values()))
    return v


def check_predicate(p: dict) -> None:
    op = p["op"]
    if op in ("is_null", "is_not_null"):
        if p.get("value") is not None or p.get("values") is not None:
            raise GraphFault(f"{op} takes no value")
    elif op == "in":
        if not p.get("values"):
            raise GraphFault("in takes values")
    elif op in ("eq", "ne", "gt", "ge", "lt", "le", "like", "not_like"):
        if "value" not in p or p.get("values") is not None:
            raise GraphFault(f"{op} takes one value")
    else:
        raise GraphFault(f"unknown operator {op}")


def predicate(p: dict) -> Column:
    c, op, v = F.col(f"`{p['property']}`"), p["op"], scalar(p.get("value"))
    if op in ("is_null", "is_not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op == "in":
        return c.isin([x for x in map(scalar, p["values"]) if x is not None])
    if op in ("like", "not_like"):
        test = c.like(v.replace("\\", "\\\\"))
        return test if op == "like" else ~test
    return {"eq": c == v, "ne": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[op]


def filtered_vertices(g: Graph, p: Pattern, v: int) -> DataFrame:
    label = next((x for x in g.vertices if x.lower() == p.vertices[v].lower()), None)
    if label is None:
        raise GraphFault(f"no vertex label {p.vertices[v]}")
    df = g.vertices[label].df
    for q in p.of("vertex", v):
        df = df.where(predicate(q))
    return df


def filtered_edges(g: Graph, p: Pattern, edge: tuple[int, str, int, int]) -> DataFrame:
    eid, label, a, b = edge
    found = [e for e in g.edges if e.label.lower() == label.lower() and e.src_label.lower() == p.vertices[a].lower() and e.dst_label.lower() == p.vertices[b].lower()]
    if not found:
        raise GraphFault(f"no edge {label} from {p.vertices[a]} to {p.vertices[b]}")
    df = None
    for e in found:
        df = e.df if df is None else df.unionByName(e.df, allowMissingColumns=True)
    for q in p.of("edge", eid):
        df = df.where(predicate(q))
    return df.select(F.col(SRC).alias("s"), F.col(DST).alias("d"))


def exact_tree_count(g: Graph, p: Pattern) -> DataFrame:
    """(cardinality): homomorphic matches of a tree pattern, folded bottom-up; one join and one sum an edge."""
    if not p.is_tree():
        raise GraphFault("the pattern isn't a tree")

    def fold(v: int, over: int | None) -> DataFrame:
        """(_vid, w): the vertices for pattern vertex v, with the number of matches below it."""
        bare = g.closed and not p.of("vertex", v)
        df = None if bare else filtered_vertices(g, p, v).select(VID).withColumn("w", F.lit(1).cast("long"))
        for e in p.edges:
            if v not in e[2:] or e[0] == over:
                continue
            down = e[2] == v
            child = e[3] if down else e[2]
            here, there = ("s", "d") if down else ("d", "s")
            edges = filtered_edges(g, p, e)
            below = fold(child, e[0])
            ways = (edges.select(F.col(here).alias(VID), F.lit(1).cast("long").alias("u")) if below is None else edges.join(below.select(F.col(VID).alias(there), F.col("w").alias("u")), there).select(F.col(here).alias(VID), "u")).groupBy(VID).agg(F.sum("u").alias("u"))
            df = ways.select(VID, F.col("u").alias("w")) if df is None else df.join(ways, VID).select(VID, (F.col("w") * F.col("u")).alias("w"))
        return df

    root = fold(next(iter(p.vertices)), None)
    if root is None:
        root = filtered_vertices(g, p, next(iter(p.vertices))).select(F.lit(1).cast("long").alias("w"))
    return root.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("cardinality"))


def exact_count(g: Graph, p: Pattern) -> DataFrame:
    """(cardinality) of any connected pattern: trees are folded, cycles are joined edge by edge."""
    if p.is_tree():
        return exact_tree_count(g, p)
    df, bound, left = None, set(), list(p.edges)
    while left:
        e = next((x for x in left if bound & set(x[2:])), left[0])
        left.remove(e)
        one = filtered_edges(g, p, e).select(F.col("s").alias(f"v{e[2]}"), *([F.col("d").alias(f"v{e[3]}")] if e[2] != e[3] else [])) if e[2] != e[3] else filtered_edges(g, p, e).where("s = d").select(F.col("s").alias(f"v{e[2]}"))
        common = [c for c in one.columns if df is not None and c in df.columns]
        df = one if df is None else df.join(one, common) if common else df.crossJoin(one)
        bound |= set(e[2:])
    for v in p.vertices:
        if p.of("vertex", v) or not g.closed or f"v{v}" not in df.columns:
            vs = filtered_vertices(g, p, v).select(F.col(VID).alias(f"v{v}"))
            df = df.join(vs, f"v{v}") if f"v{v}" in df.columns else df.crossJoin(vs)
    return df.agg(F.count("*").alias("cardinality"))


def degrees(g: Graph, label: str, edge: str, direction: str) -> DataFrame:
    """(_vid, degree): neighbours of each vertex of a label along one edge label; vertices without one are left out."""
    at, own = (SRC, "src_label") if direction == "out" else (DST, "dst_label")
    df = None
    for e in g.edges:
        if e.label == edge and getattr(e, own) == label:
            one = e.df.select(F.col(at).alias(VID))
            df = one if df is None else df.unionByName(one)
    if df is None:
        raise GraphFault(f"no edge {edge} at {label}")
    return df.groupBy(VID).agg(F.count("*").alias("degree"))


def path_degrees(g: Graph, steps: list[tuple[str, str, str]]) -> DataFrame:
    """(_vid, degree) of the first label: the number of walks along steps (label, edge, direction) from each vertex."""
    out: DataFrame | None = None
    for label, edge, direction in reversed(steps):
        if out is None:
            out = degrees(g, label, edge, direction)
            continue
        here, there = (SRC, DST) if direction == "out" else (DST, SRC)
        own = "src_label" if direction == "out" else "dst_label"
        edges = None
        for e in g.edges:
            if e.label == edge and getattr(e, own) == label:
                one = e.df.select(F.col(here).alias("_h"), F.col(there).alias(VID))
                edges = one if edges is None else edges.unionByName(one)
        out = edges.join(out, VID).groupBy("_h").agg(F.sum("degree").alias("degree")).withColumnRenamed("_h", VID)
    return out


def star_degrees(g: Graph, label: str, arms: list[tuple[str, str]]) -> DataFrame:
    """(_vid, degree): the product of the degrees of several arms (edge, direction) at one centre."""
    out = None
    for i, (edge, direction) in enumerate(arms):
        one = degrees(g, label, edge, direction).withColumnRenamed("degree", f"d{i}")
        out = one if out is None else out.join(one, VID)
    product = F.lit(1).cast("long")
    for i in range(len(arms)):
        product = product * F.col(f"d{i}")
    return out.select(VID, product.alias("degree"))


def histogram(degree: DataFrame) -> DataFrame:
    """(bucket, vertices, largest): degrees in exponential buckets of base 2; bucket i holds 2**(i-1) < degree <= 2**i."""
    bucket = F.when(F.col("degree") <= 1, 0).otherwise(F.ceil(F.log2("degree"))).cast("int")
    return degree.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("vertices"), F.max("degree").alias("largest"))


def column_stats(df: DataFrame) -> DataFrame:
    """(column, total, nulls, low, high, ndv) of each column, in one pass; ndv by HyperLogLog."""
    names = df.columns
    aggs = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        plain = not any(x in df.schema[c].dataType.simpleString() for x in ("array", "map", "struct"))
        aggs += [F.count_if(col.isNull()).alias(f"n{i}"), (F.min(col) if plain else F.lit(None)).cast("string").alias(f"l{i}"), (F.max(col) if plain else F.lit(None)).cast("string").alias(f"h{i}"), (F.approx_count_distinct(col) if plain else F.lit(None)).cast("long").alias(f"d{i}")]
    one = df.agg(F.count("*").alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("total"), F.col(f"n{i}").alias("nulls"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"d{i}").alias("ndv")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
