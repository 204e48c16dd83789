"""Property graphs as immutable sets of DataFrames, and the catalog that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VID, EID, SRC, DST, LABEL = "_vid", "_eid", "_src", "_dst", "_label"


class GraphFault(ValueError):
    """A graph or catalog object is missing, doubled, or not what it should be."""


class _Rows:
    """A frame that is given, or read when it is first asked for: a graph opens only the tables that a query touches."""

    source: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) and not isinstance(self.source, DataFrame) else self.source


@dataclass(frozen=True, eq=False)
class VertexSet(_Rows):
    """The vertices of one label: _vid and properties."""

    label: str
    source: DataFrame | Callable[[], DataFrame]
    required: frozenset[str] = frozenset()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c != VID]


@dataclass(frozen=True, eq=False)
class EdgeSet(_Rows):
    """The edges of one label between two vertex labels: _eid, _src, _dst and properties.

    Where each edge stands in the same row as the vertex at one end (a foreign key), `host` names that end (src or dst) and
    `hosted` gives the rows with _eid, _src, _dst and that vertex's properties, so that a pattern reads both in one scan.
    """

    label: str
    src_label: str
    dst_label: str
    source: DataFrame | Callable[[], DataFrame]
    required: frozenset[str] = frozenset()
    host: str = ""
    hosted: Callable[[], DataFrame] | None = None

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in (EID, SRC, DST)]


@dataclass(frozen=True)
class VectorIndex:
    name: str
    label: str
    property: str
    dimension: int


@dataclass(frozen=True)
class Graph:
    """One version of a graph.  Changes make new versions, so a reader never sees half of one.

    With `closed` the ends of every edge are known to exist (imports check it), which lets patterns skip joins with
    vertices of which nothing is asked.
    """

    name: str
    vertices: dict[str, VertexSet] = field(default_factory=dict)
    edges: tuple[EdgeSet, ...] = ()
    closed: bool = True
    version: int = 0
    indexes: dict[str, VectorIndex] = field(default_factory=dict)

    def label_id(self, label: str) -> int:
        return [*self.vertices, *dict.fromkeys(e.label for e in self.edges)].index(label) + 1

    def edge_sets(self, label: str) -> list[EdgeSet]:
        return [e for e in self.edges if e.label == label]

    def changed(self, vertices: dict[str, VertexSet] | None = None, edges: tuple[EdgeSet, ...] | None = None, **more: object) -> Graph:
        """A new version.  Changed vertices or edges are no longer the rows that hosted edges were read from."""
        v, e = self.vertices if vertices is None else vertices, self.edges if edges is None else edges
        if vertices is not None or edges is not None:
            e = tuple(replace(x, host="", hosted=None) if x.host else x for x in e)
        return replace(self, vertices=v, edges=e, version=self.version + 1, **more)

    def vertex_frame(self, labels: list[str] | None = None) -> DataFrame:
        """All vertices of the labels, with their label; properties that a label lacks are null."""
        out = None
        for label in labels or list(self.vertices):
            df = self.vertices[label].df.withColumn(LABEL, F.lit(label))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise GraphFault(f"graph {self.name} has no vertices of {labels}")
        return out

    def edge_frame(self, label: str | None = None) -> DataFrame:
        """All edges (of a label), with label and end labels."""
        out = None
        for e in self.edges:
            if label in (None, e.label):
                df = e.df.withColumn(LABEL, F.lit(e.label)).withColumn("_src_label", F.lit(e.src_label)).withColumn("_dst_label", F.lit(e.dst_label))
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise GraphFault(f"graph {self.name} has no edges {label or ''}")
        return out

    # -- versions
    def add_vertices(self, label: str, rows: DataFrame) -> Graph:
        old = self.vertices.get(label)
        df = rows if old is None else old.df.unionByName(rows, allowMissingColumns=True)
        return self.changed(vertices=self.vertices | {label: VertexSet(label, df)})

    def add_edges(self, label: str, src_label: str, dst_label: str, rows: DataFrame) -> Graph:
        out, found = [], False
        for e in self.edges:
            if (e.label, e.src_label, e.dst_label) == (label, src_label, dst_label):
                e, found = replace(e, source=e.df.unionByName(rows, allowMissingColumns=True)), True
            out.append(e)
        return self.changed(edges=(*out, *(() if found else (EdgeSet(label, src_label, dst_label, rows),))))

    def delete_vertices(self, label: str, ids: DataFrame) -> Graph:
        """Without the vertices of `ids` (_vid) and the edges at them."""
        gone = ids.select(VID).distinct()
        edges = []
        for e in self.edges:
            df = e.df
            for end, at in ((e.src_label, SRC), (e.dst_label, DST)):
                if end == label:
                    df = df.join(gone.withColumnRenamed(VID, at), at, "left_anti")
            edges.append(replace(e, source=df.select(*e.df.columns)))
        kept = self.vertices[label].df.join(gone, VID, "left_anti").select(*self.vertices[label].df.columns)
        return self.changed(vertices=self.vertices | {label: replace(self.vertices[label], source=kept)}, edges=tuple(edges))

    def delete_edges(self, label: str, ids: DataFrame) -> Graph:
        gone = ids.select(EID).distinct()
        return self.changed(edges=tuple(replace(e, source=e.df.join(gone, EID, "left_anti").select(*e.df.columns)) if e.label == label else e for e in self.edges))

    def set_property(self, label: str, name: str, value: Callable[[DataFrame], object]) -> Graph:
        """A vertex property, new or replaced, by a column over the label's frame."""
        v = self.vertices[label]
        return self.changed(vertices=self.vertices | {label: replace(v, source=v.df.withColumn(name, value(v.df)))})


class Catalog:
    """Schemas with their graphs and graph types; every commit checks the version that it began from."""

    def __init__(self) -> None:
        self.schemas: dict[str, dict[str, Graph]] = {"default": {}}
        self.types: dict[str, str] = {}

    def graphs(self, schema: str) -> dict[str, Graph]:
        if schema not in self.schemas:
            raise GraphFault(f"schema {schema} doesn't exist")
        return self.schemas[schema]

    def graph(self, schema: str, name: str) -> Graph:
        graphs = self.graphs(schema)
        if name not in graphs:
            raise GraphFault(f"graph {name} doesn't exist")
        return graphs[name]

    def register(self, schema: str, graph: Graph, replace_old: bool = False) -> None:
        if graph.name in self.graphs(schema) and not replace_old:
            raise GraphFault(f"graph {graph.name} exists already")
        self.schemas[schema][graph.name] = graph

    def commit(self, schema: str, before: Graph, after: Graph) -> None:
        """Publishes a new version unless another one has come in between."""
        if self.graph(schema, before.name).version != before.version:
            raise GraphFault(f"graph {before.name} was changed meanwhile")
        self.schemas[schema][before.name] = after

    def snapshot(self) -> dict[str, dict[str, Graph]]:
        return {s: dict(g) for s, g in self.schemas.items()}

    def restore(self, saved: dict[str, dict[str, Graph]]) -> None:
        self.schemas = {s: dict(g) for s, g in saved.items()}
