"""Procedures that CALL reaches, and what they keep in the session."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .estimate.catalog import Statistics
from .estimate.tree import TREES, Estimator
from .estimate.wander import wander_join
from .graph import DST, EID, SRC, VID, Graph, GraphFault
from .operators import mutate
from .operators.patterns import Pattern
from .scratch import written
from .sources import fixtures, manifest

if TYPE_CHECKING:
    from .session import Session


@dataclass(frozen=True)
class Procedure:
    name: str
    params: str
    run: Callable[..., DataFrame | None]


PROCEDURES: dict[str, Procedure] = {}


def procedure(params: str) -> Callable:
    def add(f: Callable) -> Callable:
        name = f.__name__.lower()
        PROCEDURES[name] = Procedure(name, params, f)
        return f

    return add


def rows(s: Session, data: list[tuple], schema: str) -> DataFrame:
    return s.spark.createDataFrame(data, schema)


def publish(s: Session, before: Graph, after: Graph) -> None:
    s.catalog.commit(s.schema, before, after)
    s.state.setdefault("log", []).append((before, after))


# -- graphs and catalog
@procedure("text STRING")
def echo(s: Session, text: str) -> DataFrame:
    return rows(s, [(text,)], "output string")


@procedure("")
def show_procedures(s: Session) -> DataFrame:
    return rows(s, [(p.name, p.params) for p in PROCEDURES.values()], "name string, params string")


@procedure("")
def show_graph(s: Session) -> DataFrame:
    return rows(s, [(n,) for n in sorted(s.catalog.graphs(s.schema))], "graph_name string")


@procedure("name STRING")
def create_test_graph(s: Session, name: str) -> None:
    s.catalog.register(s.schema, Graph(name))


@procedure("name STRING, n INT8")
def create_test_graph_data(s: Session, name: str, n: int) -> None:
    s.catalog.register(s.schema, fixtures.people_graph(s.spark, name, n))


@procedure("name STRING, n INT8")
def create_test_vector_graph_data(s: Session, name: str, n: int) -> None:
    s.catalog.register(s.schema, fixtures.vector_graph(s.spark, name, n))


@procedure("graph STRING, manifest STRING")
def import_graph(s: Session, name: str, path: str) -> None:
    s.catalog.register(s.schema, manifest.import_graph(s.spark, name, path))


@procedure("graph STRING, folder STRING, manifest STRING")
def export_graph(s: Session, name: str, folder: str, path: str = "manifest.json") -> None:
    manifest.export_graph(s.spark, s.catalog.graph(s.schema, name), folder, path)


@procedure("folder STRING, manifest STRING")
def build_ldbc_manifest(s: Session, folder: str, path: str) -> None:
    manifest.build_manifest(s.spark, folder, path)


@procedure("graph STRING, operation STRING, label_a STRING, label_b STRING, edge_label STRING, count INT64, percent FLOAT64")
def mutate_graph(s: Session, name: str, operation: str, a: str, b: str | None = None, edge: str | None = None, count: int | None = None, percent: float | None = None) -> DataFrame:
    g = s.catalog.graph(s.schema, name)
    if operation == "add_edges":
        total = sum(e.df.count() for e in g.edge_sets(edge))
        n = mutate.amount(count, percent, total)
        new, label = mutate.add_edges(g, edge, a, b, n), edge
    elif operation in ("add_vertices", "delete_vertices"):
        total = g.vertices[a].df.count()
        n, label = mutate.amount(count, percent, total), a
        n = min(n, total) if operation == "delete_vertices" else n
        new = getattr(mutate, operation)(g, a, n)
    else:
        raise GraphFault(f"unknown operation {operation}")
    publish(s, g, new)
    return rows(s, [(operation, label, n)], "operation string, label string, changed long")


# -- statistics
def statistics(s: Session) -> Statistics:
    g = s.graph
    held = s.state.get("statistics")
    if held is None or held.graph.name != g.name or held.graph.version != g.version:
        held = s.state["statistics"] = Statistics(g, bool(s.options["max_bucket"]))
    return held


@procedure("folder STRING, graph STRING, max_k INT8")
def load_ldbc(s: Session, folder: str, name: str, most: int) -> None:
    s.catalog.register(s.schema, manifest.load_csv_topology(s.spark, folder, name))
    s.use_graph(name)
    create_catalog(s, most)


@procedure("graph STRING")
def load_flatgraph(s: Session, name: str) -> None:
    """Keeps the graph's ids and ends as tables of their own, read instead of the source from now on."""
    g = s.catalog.graph(s.schema, name)
    edges = tuple(type(e)(e.label, e.src_label, e.dst_label, written(e.df, "flat"), e.required) for e in g.edges)
    vertices = {k: type(v)(v.label, written(v.df, "flat"), v.required) for k, v in g.vertices.items()}
    s.catalog.commit(s.schema, g, g.changed(vertices, edges))


@procedure("max_k INT8")
def create_catalog(s: Session, most: int = 2) -> DataFrame:
    table = written(statistics(s).build(most), "catalog")
    s.state["catalog"] = table
    return table


@procedure("path STRING")
def load_catalog(s: Session, path: str) -> DataFrame:
    s.state["catalog"] = s.spark.read.parquet(path)
    return s.state["catalog"]


@procedure("query STRING, k INT8, sample INT32, apply INT8, verbose BOOL, max_subgraphs INT32, decomposition STRING, unit_walks INT32")
def gcard_query(s: Session, query: str, hops: int = 2, sample: int = 1000, apply: int = 0, verbose: bool = False, trees: int | None = None, decomposition: str | None = None, walks: int | None = None) -> DataFrame:
    """An estimate of the number of matches.  With sample 0, predicates are judged by column statistics alone."""
    e = Estimator(statistics(s), hops, apply, sample, trees or TREES, bool(s.options["functional_refine"]), s.options["max_star_length"], s.options["max_star_degree"])
    return rows(s, [(e.estimate(Pattern.parse(json.loads(query)), json.loads(decomposition) if decomposition else None),)], "cardinality long")


@procedure("query STRING, ratio FLOAT64, iterations INT32, seed INT64")
def wander_join_query(s: Session, query: str, ratio: float, iterations: int = 1, seed: int = 0) -> DataFrame:
    return rows(s, [(math.ceil(wander_join(s.graph, Pattern.parse(json.loads(query)), ratio, seed, iterations)),)], "cardinality long")


@procedure("max_star_length INT8, max_star_degree INT8")
def set_gcard_star_config(s: Session, length: int, degree: int) -> None:
    """Edges of an arm and arms of a star whose degrees are multiplied vertex by vertex, at most."""
    s.options |= {"max_star_length": length, "max_star_degree": degree}


@procedure("")
def compact_gcard_log(s: Session) -> DataFrame:
    """Takes in the changes since the statistics were made: only walks over changed edge labels are computed anew."""
    log = s.state.get("log", [])
    old: Statistics | None = s.state.get("statistics")
    if old is not None:
        changed = {e.label for before, after in log for e in after.edges if not any(e is x for x in before.edges)} | {x for before, after in log for x in after.vertices if after.vertices[x] is not before.vertices.get(x)}
        new = Statistics(s.graph, old.exact_top)
        for steps, table in old.tables.items():
            if not changed & {x for v, e, _ in steps for x in (v, e)}:
                new.tables[steps] = table
                if steps in old.buckets:
                    new.buckets[steps] = old.buckets[steps]
        s.state["statistics"] = new
    s.state["log"] = []
    return rows(s, [(len(log),)], "pending_entries long")


@procedure("path STRING")
def gcard_stat_quality(s: Session, path: str | None = None) -> DataFrame:
    """The share of entries that compression cut off; degrees are kept exactly, so there are none."""
    return rows(s, [(0.0,)], "ratio double")


@procedure("ratio FLOAT64, path STRING, seed INT64, vertex_label STRING, edge_label STRING")
def random_update(s: Session, ratio: float, path: str | None = None, seed: int = 0, vertex: str | None = None, edge: str | None = None) -> DataFrame:
    """Deletes a random share of vertices (with their edges) and edges; what went is written to the path, if there is one."""
    g = new = s.graph
    gone = 0
    for label in [vertex] if vertex else [] if edge else list(g.vertices):
        part = written(mutate.random_part(g.vertices[label].df.select(VID), ratio, seed), "gone")
        gone += part.count()
        new = new.delete_vertices(label, part)
    cut = 0
    for label in [edge] if edge else []:
        part = written(mutate.random_part(g.edge_frame(label).select(EID, SRC, DST), ratio, seed), "gone")
        cut += part.count()
        if path:
            part.write.mode("overwrite").parquet(f"{path}/{label}")
        new = new.delete_edges(label, part)
    publish(s, g, new)
    return rows(s, [(gone, cut)], "vertices long, edges long")


@procedure("ratio FLOAT64, path STRING, seed INT64, vertex_label STRING, edge_label STRING")
def random_insert(s: Session, ratio: float, path: str | None = None, seed: int = 0, vertex: str | None = None, edge: str | None = None) -> DataFrame:
    """Puts a share of edges in again under new ids (from the path, where random_update has left them)."""
    g = new = s.graph
    added = 0
    for e in g.edges:
        if edge and e.label != edge:
            continue
        part = s.spark.read.parquet(f"{path}/{e.label}") if path else mutate.random_part(e.df.select(EID, SRC, DST), ratio, seed)
        top = g.edge_frame().agg(F.coalesce(F.max(EID), F.lit(-1)).alias("m"))
        part = written(part.crossJoin(F.broadcast(top)).select((F.monotonically_increasing_id() + F.col("m") + 1).alias(EID), SRC, DST), "added")
        added += part.count()
        new = new.add_edges(e.label, e.src_label, e.dst_label, part)
    publish(s, g, new)
    return rows(s, [(0, added)], "vertices long, edges long")


@procedure("folder STRING")
def export_edge_csv(s: Session, folder: str) -> None:
    for e in s.graph.edges:
        e.df.select(SRC, DST).write.mode("overwrite").csv(f"{folder}/{e.src_label}_{e.label}_{e.dst_label}.csv", header=True)


@procedure("folder STRING")
def export_flatgraph_snapshot(s: Session, folder: str) -> None:
    manifest.save_snapshot(s.spark, s.graph, folder)


@procedure("")
def gcard_snapshot(s: Session) -> None:
    s.state["kept"] = (s.graph, s.state.get("statistics"), list(s.state.get("log", [])))


@procedure("")
def gcard_restore(s: Session) -> None:
    if "kept" not in s.state:
        raise GraphFault("no snapshot was taken")
    g, s.state["statistics"], s.state["log"] = s.state["kept"]
    s.catalog.register(s.schema, g, replace_old=True)


__all__ = ["PROCEDURES", "Procedure"]
