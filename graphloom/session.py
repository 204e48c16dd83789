"""A session: a current schema and graph, parameters, transactions, and query text in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import Catalog, Graph, GraphFault, VectorIndex
from .plans import ast as A
from .plans.compile import BindFault, Compiler, outline
from .plans.parser import parse

#: Options that sessions have, with their values at the start.
OPTIONS = {"functional_refine": True, "max_bucket": False, "max_star_length": 2, "max_star_degree": 3, "explain_physical": False}


class Session:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, user: str = "user") -> None:
        self.spark, self.catalog, self.user = spark, catalog or Catalog(), user
        self.schema, self.current, self.params, self.options, self.closed = "default", None, {}, dict(OPTIONS), False
        self.saved: dict | None = None
        self.state: dict[str, object] = {}  # what procedures keep: statistics, logs, snapshots

    # -- graphs
    @property
    def graph(self) -> Graph:
        if self.current is None:
            raise GraphFault("no current graph")
        return self.catalog.graph(self.schema, self.current)

    def use_graph(self, graph: Graph | str) -> Session:
        if isinstance(graph, Graph):
            self.catalog.register(self.schema, graph, replace_old=True)
            self.current = graph.name
        else:
            self.catalog.graph(self.schema, graph)
            self.current = graph
        return self

    def resolve(self, name: str | None) -> Graph:
        return self.graph if name is None else self.catalog.graph(self.schema, name)

    # -- text
    def gql(self, text: str) -> DataFrame | None:
        """Runs the statements of a text; the last one's result, which stays lazy."""
        if self.closed:
            raise GraphFault("the session is closed")
        out = None
        for statement in parse(text):
            out = self.run(statement)
        return out

    def run(self, q: A.Query | A.Command) -> DataFrame | None:
        if isinstance(q, A.Command):
            return getattr(self, f"_{q.name}")(**q.args)
        if isinstance(q, A.Linear) and len(q.parts) == 1 and isinstance(q.parts[0], A.Use):
            self.use_graph(self.resolve(q.parts[0].graph).name)
            return None
        if isinstance(q, A.Linear) and len(q.parts) == 1 and isinstance(q.parts[0], A.Call) and q.parts[0].inline is None and q.parts[0].yields is None:
            c = self.compiler()
            return self.call(q.parts[0].name, [c.constant(a) for a in q.parts[0].args])
        return self.compiler().run(q)

    def compiler(self) -> Compiler:
        graph = self.catalog.graph(self.schema, self.current) if self.current is not None else Graph("empty")
        return Compiler(self.spark, graph, self.params, self.user, self.resolve, self.call)

    def call(self, name: str, args: list) -> DataFrame | None:
        from .procedures import PROCEDURES

        p = PROCEDURES.get(name.lower())
        if p is None:
            raise BindFault(f"procedure {name} doesn't exist")
        return p.run(self, *args)

    # -- commands
    def _explain(self, query: A.Query | A.Command) -> DataFrame:
        lines = ["Explain:"] + (outline(query, 1) if not isinstance(query, A.Command) else [f"  {query.name.title()}"])
        if self.options["explain_physical"] and not isinstance(query, A.Command):
            lines += ["", *self.compiler().run(query)._jdf.queryExecution().simpleString().splitlines()]
        return self.spark.createDataFrame([(x,) for x in lines], "plan string")

    def _set(self, kind: str, name: str | None, value: A.Expr | None = None) -> None:
        if kind == "GRAPH":
            self.use_graph(name if name.upper() not in ("CURRENT_GRAPH", "CURRENT_PROPERTY_GRAPH") else self.graph.name)
        elif kind == "SCHEMA":
            if name not in ("/", "CURRENT_SCHEMA"):
                self.catalog.graphs(name)
            self.schema, self.current = "default" if name == "/" else self.schema if name == "CURRENT_SCHEMA" else name, None
        elif kind == "TIME ZONE":
            self.spark.conf.set("spark.sql.session.timeZone", str(self.compiler().constant(value)))
        elif name in self.options:
            self.options[name] = self.compiler().constant(value)
        else:
            self.params[name] = self.compiler().constant(value)

    def _reset(self, kind: str, name: str | None) -> None:
        if kind == "SCHEMA":
            self.schema = "default"
        elif kind == "GRAPH":
            self.current = None
        elif name in self.options:
            self.options[name] = OPTIONS[name]
        elif name:
            self.params.pop(name, None)
        else:
            self.schema, self.current, self.params, self.options = "default", None, {}, dict(OPTIONS)

    def _close(self) -> None:
        self.closed = True

    def _start(self, mode: str) -> None:
        if self.saved is not None:
            raise GraphFault("a transaction is open already")
        self.saved = self.catalog.snapshot()

    def _commit(self) -> None:
        if self.saved is None:
            raise GraphFault("no transaction is open")
        self.saved = None

    def _rollback(self) -> None:
        if self.saved is None:
            raise GraphFault("no transaction is open")
        self.catalog.restore(self.saved)
        self.saved = None

    def _catalog(self, verb: str, kind: str, name: str, lenient: bool = False, replace: bool = False, **more: object) -> None:
        if kind == "VECTOR":
            return self._vector_index(verb, name, lenient, **more)
        where = {"SCHEMA": self.catalog.schemas, "GRAPH": self.catalog.graphs(self.schema), "GRAPH TYPE": self.catalog.types}[kind]
        if verb == "create":
            if name in where and not replace:
                if lenient:
                    return None
                raise GraphFault(f"{kind.lower()} {name} exists already")
            if kind == "GRAPH":
                source = self.catalog.graph(self.schema, more["copy"]) if "copy" in more else Graph(name)
                where[name] = Graph(name, source.vertices, source.edges, source.closed)
            else:
                where[name] = {} if kind == "SCHEMA" else str(more.get("body", ""))
        elif name not in where:
            if not lenient:
                raise GraphFault(f"{kind.lower()} {name} doesn't exist")
        elif verb == "truncate":
            where[name] = Graph(name)
        else:
            del where[name]
            if kind == "GRAPH" and self.current == name:
                self.current = None
        return None

    def _vector_index(self, verb: str, name: str, lenient: bool, label: str = "", property: str = "", **_: object) -> None:
        from .operators.vector import dimension

        g = self.graph
        if verb == "create":
            if name in g.indexes or any((i.label, i.property) == (label, property) for i in g.indexes.values()):
                if lenient:
                    return
                raise GraphFault(f"vector index {name} exists already")
            if label not in g.vertices or property not in g.vertices[label].properties:
                raise BindFault(f"{label}.{property} doesn't exist")
            index = VectorIndex(name, label, property, dimension(g.vertices[label].df, property))
            self.catalog.commit(self.schema, g, g.changed(indexes=g.indexes | {name: index}))
        elif name not in g.indexes:
            if not lenient:
                raise GraphFault(f"vector index {name} doesn't exist")
        else:
            self.catalog.commit(self.schema, g, g.changed(indexes={k: v for k, v in g.indexes.items() if k != name}))
