"""Degree statistics of label walks: which walks there are, their keys, and their histograms."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import VID, Graph
from ..operators.patterns import column_stats, histogram, path_degrees
from ..scratch import written
from .pcf import Pcf

Step = tuple[str, str, str]  # vertex label, edge label, direction


def schema_walks(g: Graph, most: int) -> list[tuple[list[Step], str]]:
    """All label walks of up to `most` edges over the schema, either way along edges: steps and the last label."""
    hops: dict[str, list[tuple[str, str, str]]] = {}
    for e in g.edges:
        for a, b, way in ((e.src_label, e.dst_label, "out"), (e.dst_label, e.src_label, "in")):
            if (e.label, way, b) not in hops.setdefault(a, []):
                hops[a].append((e.label, way, b))
    out, level = [], [([], v) for v in g.vertices]
    for _ in range(most):
        level = [([*steps, (end, e, way)], to) for steps, end in level for e, way, to in sorted(hops.get(end, []))]
        out += level
    return out


def path_key(labels: list[str]) -> tuple[str, ...]:
    """Vertex and edge labels in turn, in lower case; a walk and its reverse have one key."""
    low = [x.lower() for x in labels]
    return tuple(min(low, low[::-1]))


def walk_key(steps: list[Step], end: str) -> tuple[str, ...]:
    return path_key([x for v, e, _ in steps for x in (v, e)] + [end])


class Statistics:
    """Histograms by walk, computed when they are asked for and kept; columns by label likewise.

    A walk's degrees are a join of its first hop with the degrees of the rest, which are written once and shared.
    """

    def __init__(self, graph: Graph, exact_top: bool = False) -> None:
        self.graph, self.exact_top = graph, exact_top
        self.tables: dict[tuple[Step, ...], DataFrame] = {}
        self.buckets: dict[tuple[Step, ...], list[tuple[int, int, int]]] = {}
        self.stars: dict[tuple[tuple[Step, ...], ...], list[tuple[int, int, float]]] = {}
        self.columns: dict[str, dict[str, dict]] = {}

    def degree_table(self, steps: tuple[Step, ...]) -> DataFrame:
        if steps not in self.tables:
            self.tables[steps] = written(path_degrees(self.graph, list(steps)), "degrees")
        return self.tables[steps]

    def histogram(self, steps: tuple[Step, ...]) -> list[tuple[int, int, int]]:
        if steps not in self.buckets:
            self.buckets[steps] = [(r["bucket"], r["vertices"], r["largest"]) for r in histogram(self.degree_table(steps)).collect()]  # at most 64 rows
        return self.buckets[steps]

    def pcf(self, steps: tuple[Step, ...]) -> Pcf:
        return Pcf.from_buckets(self.histogram(steps), self.exact_top)

    def star(self, arms: tuple[tuple[Step, ...], ...]) -> Pcf:
        """Products of several arms' degrees at each vertex of one label, as doubles; vertices without one of the arms are left out."""
        arms = tuple(sorted(arms))
        if arms not in self.stars:
            out, product = None, F.lit(1.0)
            for i, (steps, n) in enumerate(Counter(arms).items()):
                one = self.degree_table(steps).select(VID, F.col("degree").cast("double").alias(f"d{i}"))
                out, product = one if out is None else out.join(one, VID), product * F.pow(f"d{i}", F.lit(n))
            rows = histogram(out.select(VID, product.alias("degree"))).collect()  # a row a power of two
            self.stars[arms] = [(r["bucket"], r["vertices"], r["largest"]) for r in rows]
        return Pcf.from_buckets(self.stars[arms], self.exact_top)

    def functional(self, label: str, edge: str, direction: str) -> bool:
        """Whether each vertex has one such edge at most."""
        return all(top <= 1 for _, _, top in self.histogram(((label, edge, direction),)))

    def of_column(self, label: str, column: str) -> dict | None:
        if label not in self.columns:
            df = self.graph.vertices[label].df if label in self.graph.vertices else self.graph.edge_frame(label)
            self.columns[label] = {r["column"]: r.asDict() for r in column_stats(df).collect()}  # one row a column
        return self.columns[label].get(column)

    def build(self, most: int) -> DataFrame:
        """(path, label, bucket, vertices, largest) of all walks of up to `most` edges."""
        out = None
        for steps, end in schema_walks(self.graph, most):
            one = histogram(self.degree_table(tuple(steps))).select(F.lit("/".join(walk_key(steps, end))).alias("path"), F.lit(steps[0][0]).alias("label"), "bucket", "vertices", "largest")
            out = one if out is None else out.unionByName(one)
        return out
