"""Binds a syntax tree to a graph and turns it into DataFrame operations, which Catalyst plans.

A frame is a DataFrame with a scope.  A vertex variable v stands in it as columns v$_vid, v$_label and v$<property>, an
edge variable likewise with its ends, a value as a column of its own name.  Nothing is packed into structs before the
result, so pruning and pushdown reach the scans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..graph import DST, EID, LABEL, SRC, VID, EdgeSet, Graph, GraphFault
from ..scratch import written
from . import ast as A


class BindFault(ValueError):
    """A name, type or construct of a query doesn't fit the graph."""


@dataclass(frozen=True)
class Var:
    kind: str  # node, edge, edges, path, value
    labels: tuple[str, ...] = ()
    props: tuple[str, ...] = ()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    scope: dict[str, Var] = field(default_factory=dict)

    def columns(self, name: str) -> list[str]:
        v = self.scope[name]
        if v.kind == "node":
            return [f"{name}${c}" for c in (VID, LABEL, *v.props)]
        if v.kind == "edge":
            return [f"{name}${c}" for c in (EID, LABEL, SRC, DST, "_src_label", "_dst_label", *v.props)]
        return [name]


TYPES = {"INT8": "tinyint", "INTEGER8": "tinyint", "INT16": "smallint", "SMALLINT": "smallint", "INT32": "int", "INT": "int", "INTEGER": "int", "INT64": "bigint", "BIGINT": "bigint", "BIG INTEGER": "bigint", "INT128": "decimal(38,0)", "INT256": "decimal(38,0)", "UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT": "bigint", "UINT64": "bigint", "FLOAT16": "float", "FLOAT32": "float", "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "FLOAT64": "double", "FLOAT128": "double", "FLOAT256": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "STRING": "string", "BYTES": "binary", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "ZONED DATETIME": "timestamp", "LOCAL DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "DECIMAL": "decimal(38,10)", "DEC": "decimal(38,10)", "DURATION": "interval day to second"}


def spark_type(name: str) -> str:
    key = " ".join(name.upper().split())
    base = key.split("(")[0]
    if base in ("DECIMAL", "DEC", "CHAR", "VARCHAR") and "(" in key:
        return key.lower().replace("dec(", "decimal(")
    if base not in TYPES:
        raise BindFault(f"type {name} isn't supported")
    return TYPES[base]


def labels_of(expr: A.Expr | None, known: Iterable[str]) -> list[str]:
    """The labels that satisfy a label expression; an element has one label."""

    def holds(e: A.Expr, label: str) -> bool:
        if e.op == "label":
            return e.args[0] == label
        if e.op == "any":
            return True
        if e.op == "not":
            return not holds(e.args[0], label)
        return (any if e.op == "or" else all)(holds(a, label) for a in e.args)

    return [x for x in dict.fromkeys(known) if expr is None or holds(expr, x)]


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.op == "and" else [e]


def names_in(e: A.Expr) -> set[str]:
    out = set()
    for x in e.walk():
        if x.op == "var":
            out.add(x.args[0])
        elif x.op == "exists":
            out |= pattern_vars(x.args[0]).union(*[names_in(c) for c in exprs_of(x.args[0])])
        elif x.op == "is" and x.args[0] in ("SOURCE", "DESTINATION"):
            out.add(x.args[2])
    return out


def path_items(paths: Iterable[A.Path]) -> Iterable[A.Node | A.Edge]:
    for p in paths:
        yield from path_items(p.alternatives)
        for i in p.items:
            if isinstance(i, A.Group):
                yield from path_items([i.path])
            else:
                yield i


def pattern_vars(m: A.Match) -> set[str]:
    return {i.var for i in path_items(m.paths)}


def names_used(q: object) -> set[str]:
    """All variable names in a query, whether it binds them or takes them from around it."""
    if isinstance(q, A.Chain):
        return set().union(*[names_used(step) for step, _ in q.steps])
    if isinstance(q, A.SetOp):
        return names_used(q.left) | names_used(q.right)
    out: set[str] = set()
    for p in q.parts:
        if isinstance(p, (A.Linear, A.SetOp, A.Chain)):
            out |= names_used(p)
        elif isinstance(p, A.Call) and p.inline is not None:
            out |= names_used(p.inline) if p.scope is None else names_used(p.inline) & set(p.scope)
        elif isinstance(p, (A.Match, A.Block)):
            out = out.union(*[pattern_vars(m) for m in (p.matches if isinstance(p, A.Block) else [p])])
        elif isinstance(p, A.Return) and p.star:
            out.add("*")
        out = out.union(*[names_in(e) for e in exprs_of(p)])
    return out


def exprs_of(part: object) -> Iterable[A.Expr]:
    """All expressions directly in a part of a query, for finding which variables are asked for more than their identity."""
    if isinstance(part, A.Match):
        for i in path_items(part.paths):
            yield from (v for _, v in i.props)
            if i.where is not None:
                yield i.where
        if part.where is not None:
            yield part.where
    elif isinstance(part, A.Block):
        for m in part.matches:
            yield from exprs_of(m)
    elif isinstance(part, A.Let):
        yield from (e for _, e in part.items)
    elif isinstance(part, A.For):
        yield part.source
    elif isinstance(part, A.Filter):
        yield part.where
    elif isinstance(part, A.Call):
        yield from part.args
    elif isinstance(part, A.OrderBy):
        yield from (k.expr for k in part.keys)
    elif isinstance(part, A.Return):
        yield from (e for e, _ in part.items)
        yield from part.group or []
        if part.having is not None:
            yield part.having
        if part.order:
            yield from exprs_of(part.order)


#: Functions and tests of vertices and edges that their identity answers.
IDENTITY = {"TYPE", "LABEL", "LABELS", "ID", "ELEMENT_ID", "ALL_DIFFERENT", "SAME", "LABELED", "DIRECTED", "SOURCE", "DESTINATION", "NULL"}


def wanted(parts: list) -> set[str] | None:
    """Variables whose properties or value are used; None: all of them."""
    out: set[str] = set()
    for p in parts:
        if isinstance(p, (A.Linear, A.SetOp, A.Chain)) or isinstance(p, A.Return) and p.star or isinstance(p, A.Call) and p.inline:
            return None
        for e in exprs_of(p):
            for x in e.walk():
                if x.op == "agg" and x.args[0] == "COUNT" and x.args[1][0].op == "var":
                    continue
                if x.op == "exists":
                    out |= names_in(x)
                elif x.op == "prop" and x.args[0].op == "var":
                    out.add(x.args[0].args[0])
                elif x.op == "path" or x.op in ("call", "is") and x.args[0] in IDENTITY or x.op in ("=", "<>") and all(a.op == "var" for a in x.args):
                    continue
                elif x.op in ("call", "is", "list", "record", "case", "agg", "in", "=", "<>", "at", "prop"):
                    out |= {a.args[0] for a in _flat(x.args) if isinstance(a, A.Expr) and a.op == "var"}
            if e.op == "var":
                out.add(e.args[0])
    return out


def _flat(args: list) -> Iterable:
    for a in args:
        if isinstance(a, (list, tuple)):
            yield from _flat(a)
        else:
            yield a


#: Most repetitions that become one plan of joins (levels share their exchanges); with more, each level is written.
UNROLLED = 4
#: Fewer first steps of shortest paths aren't looked through for starts that share their way on.
SHARED = 16
#: So many pairs of a start and a vertex beyond the edge that it shares are one block.
PAIRS = 500_000


class Compiler:
    def __init__(self, spark: SparkSession, graph: Graph | None, params: dict | None = None, user: str = "user", resolve=None, procedures=None) -> None:  # noqa: ANN001
        self.spark, self.graph, self.params, self.user, self.resolve, self.procedures = spark, graph, params or {}, user, resolve, procedures
        self.fresh = 0
        #: Key columns of the row around an inline CALL; every step inside carries them and works for each key apart.
        self.carried: tuple[str, ...] = ()
        self.around: DataFrame | None = None  # their values

    # ---------------------------------------------------------------- queries
    def run(self, q: A.Query) -> DataFrame:
        return self.render(self.query(q, None))

    def render(self, f: Frame) -> DataFrame:
        """Vertices as structs with their label's id, edges as their bare id."""
        out = []
        for name, v in f.scope.items():
            if v.kind == "node":
                ids = F.create_map(*[F.lit(x) for label in v.labels for x in (label, self.graph.label_id(label))]) if v.labels else None
                fields = [F.col(f"{name}${VID}").alias(VID), (ids[F.col(f"{name}${LABEL}")] if ids is not None else F.lit(0)).alias(LABEL), *[F.col(f"{name}${p}").alias(p) for p in v.props]]
                out.append(F.when(F.col(f"{name}${VID}").isNotNull(), F.struct(*fields)).alias(name))
            elif v.kind == "edge":
                out.append(F.col(f"{name}${EID}").alias(name))
            else:
                out.append(F.col(self.tick(name)).alias(name))
        return f.df.select(*out)

    @staticmethod
    def tick(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def query(self, q: A.Query, given: Frame | None) -> Frame:
        if isinstance(q, A.Chain):
            for step, passed in q.steps:
                given = self.query(step, given)
                if passed:
                    given = self.renamed(given, passed)
            return given
        if isinstance(q, A.SetOp):
            return self.set_op(q, given)
        graph = self.graph
        try:
            return self.linear(q.parts, given)
        finally:
            self.graph = graph

    def renamed(self, f: Frame, names: list[tuple[str, str]]) -> Frame:
        cols, scope = [], {}
        for old, new in [*((k, k) for k in self.carried), *names]:
            if old not in f.scope:
                raise BindFault(f"{old} isn't a column here")
            v = f.scope[old]
            cols += [F.col(self.tick(c)).alias(new + c[len(old) :]) for c in f.columns(old)]
            scope[new] = v
        return Frame(f.df.select(*cols), scope)

    def set_op(self, q: A.SetOp, given: Frame | None) -> Frame:
        left, right = self.query(q.left, given), self.query(q.right, given)
        a, b = self.render(left), self.render(right)
        if len(a.columns) != len(b.columns):
            raise BindFault("both sides of a set operation need the same columns")
        if set(a.columns) == set(b.columns):
            b = b.select(*[F.col(self.tick(c)) for c in a.columns])
        if q.op == "UNION":
            df = a.union(b) if q.all else a.union(b).distinct()
        elif q.op == "EXCEPT":
            df = a.exceptAll(b) if q.all else a.subtract(b)
        elif q.op == "INTERSECT":
            df = a.intersectAll(b) if q.all else a.intersect(b)
        elif self.carried:  # the right side only for the rows around for which the left one is empty
            df = a.union(self.without(b, a))
        else:  # the right side only where the left one is empty: a one-row flag decides
            empty = a.limit(1).agg((F.count("*") == 0).alias("_empty"))
            df = a.union(b.join(F.broadcast(empty)).where("_empty").drop("_empty"))
        return Frame(df, {c: Var("value") for c in df.columns})

    def linear(self, parts: list, f: Frame | None) -> Frame:
        for i, p in enumerate(parts):
            refs = wanted(parts[i:])
            if isinstance(p, A.Use):
                self.graph = self.resolve(p.graph)
            elif isinstance(p, (A.Linear, A.SetOp, A.Chain)):
                f = self.query(p, f)
            elif isinstance(p, A.Match):
                if f is None and (fast := self.counted(parts[i:])) is not None:
                    return fast
                f = self.match(p, f, refs)
            elif isinstance(p, A.Block):
                inner = reduce(lambda g, m: self.match(m, g, None), p.matches, None)
                f = self.merge(f or self.one_row(), inner, "left")
            elif isinstance(p, A.Call):
                f = self.call(p, f)
            elif isinstance(p, A.Let):
                f = f or self.one_row()
                for name, e in p.items:
                    f = self.with_flags(f, [e])
                    f = Frame(f.df.withColumn(name, self.col(e, f)), f.scope | {name: Var("path" if e.op == "path" else "value")})
            elif isinstance(p, A.For):
                f = f or self.one_row()
                value = self.col(p.source, f)
                if p.counter:
                    cname, base = p.counter
                    df = f.df.select("*", F.posexplode(value).alias("_at", p.var)).withColumn(cname, (F.col("_at") + base).cast("long")).drop("_at")
                    f = Frame(df, f.scope | {p.var: Var("value"), cname: Var("value")})
                else:
                    f = Frame(f.df.select("*", F.explode(value).alias(p.var)), f.scope | {p.var: Var("value")})
            elif isinstance(p, A.Filter):
                f = self.where(f or self.one_row(), p.where)
            elif isinstance(p, A.OrderBy):
                f = self.ordered(f, p, f)
            elif isinstance(p, A.Return):
                f = self.returned(p, f or self.one_row())
        if f is None:
            raise BindFault("the query has no result")
        return f

    def one_row(self) -> Frame:
        return Frame(self.spark.range(1).select())

    # ---------------------------------------------------------------- results
    def item_columns(self, e: A.Expr, name: str, f: Frame) -> tuple[list[Column], Var]:
        if e.op == "var" and e.args[0] in f.scope:
            old, v = e.args[0], f.scope[e.args[0]]
            return [F.col(self.tick(c)).alias(name + c[len(old) :]) for c in f.columns(old)], v
        return [self.col(e, f).alias(name)], Var("value")

    def returned(self, r: A.Return, f: Frame) -> Frame:
        if r.finish:  # nothing comes out; tables need a column, so there is one
            return Frame(f.df.where(F.lit(False)).select(*self.carried, F.lit(True).alias("finished")), {c: Var("value") for c in (*self.carried, "finished")})
        items = [(A.Expr("var", [n]), n) for n, v in f.scope.items() if not n.startswith("_")] if r.star else r.items
        items = [*[(A.Expr("var", [k]), k) for k in self.carried], *items]
        f = self.with_flags(f, [e for e, _ in items])
        grouped = r.group is not None or any(x.op == "agg" for e, _ in items for x in e.walk()) or r.having is not None
        scope: dict[str, Var] = {}
        keys, values, hidden = [], [], []
        for e, name in items:
            cols, v = self.item_columns(e, name, f)
            scope[name] = v
            (values if any(x.op == "agg" for x in e.walk()) else keys).extend(cols)
        out = Frame(f.df, scope)
        order = [c for n in scope for c in out.columns(n)]
        sort: list[tuple[str | Column, bool, bool]] = []
        for i, k in enumerate(r.order.keys if r.order else []):
            if k.expr.op == "var" and k.expr.args[0] in scope and scope[k.expr.args[0]].kind == "value":
                sort.append((self.tick(k.expr.args[0]), k.ascending, k.nulls_first))
                continue
            same = next((n for e, n in items if e.op != "var" and self.alike(e, k.expr)), None)
            if same:
                sort.append((self.tick(same), k.ascending, k.nulls_first))
                continue
            hides = any(x.op == "prop" and x.args[0].op == "var" and x.args[0].args[0] in f.scope and scope.get(x.args[0].args[0], Var("value")).kind != f.scope[x.args[0].args[0]].kind for x in k.expr.walk())
            if names_in(k.expr) and names_in(k.expr) <= set(scope) and not hides and not any(x.op == "agg" for x in k.expr.walk()):
                sort.append((k.expr, k.ascending, k.nulls_first))
                continue
            if r.distinct:
                raise BindFault("ORDER BY after DISTINCT may only use result columns")
            hidden.append((f"_o{i}", k.expr))
            sort.append((f"_o{i}", k.ascending, k.nulls_first))
        extra = [(self.col(e, f).alias(n), any(x.op == "agg" for x in e.walk())) for n, e in hidden]
        if grouped:
            for i, g in enumerate(r.group or []):
                if not any(self.alike(e, g) or g.op == "var" and g.args[0] == n for e, n in items):
                    keys += [c.alias(f"_g{i}_{j}") for j, c in enumerate(self.item_columns(g, f"_g{i}", f)[0])]
            keys += [c for c, agg in extra if not agg]
            values += [c for c, agg in extra if agg]
            if r.having is not None:
                values.append(self.col(r.having, f).alias("_having"))
            df = f.df.groupBy(*keys).agg(*values) if values else f.df.select(*keys).distinct()
            if self.carried and values and len(keys) == len(self.carried):  # without groups there is a row for no rows, too
                none = f.df.where(F.lit(False)).agg(*values)
                df = df.unionByName(self.without(self.around, df).crossJoin(none))
            if r.having is not None:
                df = df.where("_having")
        else:
            df = f.df.select(*keys, *[c for c, _ in extra])
            if r.distinct:
                df = df.distinct()
        out = Frame(df, scope)
        if grouped and r.distinct:
            out = Frame(df.select(*[self.tick(c) for c in order]).distinct(), scope)
        if sort:
            cols = [(F.col(c) if isinstance(c, str) else self.col(c, out), up, first) for c, up, first in sort]
            out = Frame(out.df.orderBy(*[(c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()) for c, up, first in cols]), scope)
            out = self.paged(out, r.order, [(c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()) for c, up, first in cols])
        else:
            out = self.paged(out, r.order, [])
        return Frame(out.df.select(*[self.tick(c) for c in order]), scope)

    @staticmethod
    def alike(a: A.Expr, b: A.Expr) -> bool:
        return a.op == b.op and len(a.args) == len(b.args) and all(Compiler.alike(x, y) if isinstance(x, A.Expr) and isinstance(y, A.Expr) else str(x) == str(y) for x, y in zip(a.args, b.args, strict=True))

    def paged(self, f: Frame, order: A.OrderBy | None, by: list[Column]) -> Frame:
        df = f.df
        if self.carried and order is not None and (order.offset is not None or order.limit is not None):
            first = self.count_of(order.offset) if order.offset is not None else 0
            at = F.col("_at")
            df = df.withColumn("_at", F.row_number().over(Window.partitionBy(*self.carried).orderBy(*(by or [F.lit(0)])))).where(at > first)
            df = df.where(at <= first + self.count_of(order.limit)) if order.limit is not None else df
            return Frame(df.drop("_at"), f.scope)
        if order is not None and order.offset is not None:
            df = df.offset(self.count_of(order.offset))
        if order is not None and order.limit is not None:
            df = df.limit(self.count_of(order.limit))
        return Frame(df, f.scope)

    def count_of(self, e: A.Expr) -> int:
        value = self.params.get(e.args[0]) if e.op == "param" else e.args[0] if e.op == "lit" else None
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise BindFault("LIMIT and OFFSET take a whole number")
        return value

    def ordered(self, f: Frame, o: A.OrderBy, scope: Frame) -> Frame:
        cols = [(self.col(k.expr, scope), k.ascending, k.nulls_first) for k in o.keys]
        by = [(c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()) for c, up, first in cols]
        return self.paged(Frame(f.df.orderBy(*by) if by else f.df, f.scope), o, by)

    # ---------------------------------------------------------------- procedures
    def call(self, c: A.Call, f: Frame | None) -> Frame:
        if c.inline is not None:
            return self.inline(c, f)
        args = [self.constant(a) for a in c.args]
        df = self.procedures(c.name, args)
        if df is None:
            df = self.spark.createDataFrame([], "done boolean").select()
        names = c.yields or [(n, n) for n in df.columns]
        if c.yields and [a for a, _ in c.yields] != df.columns:
            raise BindFault(f"{c.name} yields {df.columns}")
        out = Frame(df.select(*[F.col(a).alias(b) for a, b in names]), {b: Var("value") for _, b in names})
        if f is None:
            return out
        return self.merge(f, out, "left" if c.optional else "inner")

    def inline(self, c: A.Call, f: Frame | None) -> Frame:
        """CALL {...}: the query inside runs for each row around it, that is, once for all distinct values of the variables
        that it uses; its steps carry these as key columns, by which its rows meet the rows around again."""
        if f is None:
            return self.query(c.inline, None)
        names = names_used(c.inline)
        used = [n for n in f.scope if ("*" in names or n in names) and (c.scope is None or n in c.scope) and n not in self.carried]
        kept, self.carried, graph = (self.carried, self.around), (), self.graph
        try:
            if not used:
                inner, on = self.query(c.inline, None), []
            else:
                self.fresh += 1
                copies = {f"_k{self.fresh}_{i}": F.col(self.tick(k)) for i, k in enumerate(k for n in used for k in self.key_columns(f, n))}
                rows = f.df.select(*[self.tick(k) for n in used for k in f.columns(n)], *[k.alias(name) for name, k in copies.items()]).dropDuplicates(list(copies))
                self.carried, self.around = tuple(copies), rows.select(*copies)
                inner = self.query(c.inline, Frame(rows, {n: f.scope[n] for n in used} | {k: Var("value") for k in copies}))
                on = [k.eqNullSafe(F.col(f"_r{name}")) for name, k in copies.items()]
        finally:
            (self.carried, self.around), self.graph, own = kept, graph, self.carried
        new = {n: v for n, v in inner.scope.items() if n not in own and not (n in f.scope and v.kind in ("node", "edge") and n in used)}
        if clash := sorted(set(new) & set(f.scope)):
            raise BindFault(f"{', '.join(clash)} is bound around the CALL already")
        right = inner.df.select(*[F.col(k).alias(f"_r{k}") for k in own], *[self.tick(k) for n in new for k in inner.columns(n)])
        how = "left" if c.optional else "inner"
        df = f.df.join(right, reduce(lambda x, y: x & y, on), how) if on else f.df.crossJoin(right) if how == "inner" else f.df.join(right, F.lit(True), how)
        return Frame(df.drop(*[f"_r{k}" for k in own]), f.scope | new)

    def without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """The rows whose carried keys don't occur in the others."""
        right = others.select(*[F.col(k).alias(f"_r{k}") for k in self.carried])
        return rows.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in self.carried]), "left_anti")

    @staticmethod
    def key_columns(f: Frame, n: str) -> list[str]:
        """The columns that identify what a variable holds."""
        ids = {"node": (VID, LABEL), "edge": (EID, LABEL)}.get(f.scope[n].kind)
        return [f"{n}${c}" for c in ids] if ids else [n]

    def constant(self, e: A.Expr) -> object:
        if e.op == "lit":
            return e.args[0]
        if e.op == "param":
            return self.params[e.args[0]]
        if e.op == "neg":
            return -self.constant(e.args[0])
        if e.op in ("list", "vector"):
            return [self.constant(a) for a in e.args]
        return self.one_row().df.select(self.col(e, self.one_row()).alias("x")).first()["x"]

    # ---------------------------------------------------------------- patterns
    def match(self, m: A.Match, given: Frame | None, refs: set[str] | None) -> Frame:
        f: Frame | None = None
        asked = {i.var for i in path_items(m.paths)} if refs is None else refs
        if given is not None:
            plain, m = m, self.hoisted(m, set(given.scope) - pattern_vars(m))
            asked = asked if m is plain else asked | names_in(m.where)
        whole = m.different_edges and any(p.alternatives or any(isinstance(i, A.Group) or isinstance(i, A.Edge) and i.low is not None for i in p.items) for p in m.paths)
        walked = [f"_edges{n}" for n in range(len(m.paths))] if whole else []
        for n, p in enumerate(m.paths):
            held = {n for x in (given, f) if x is not None for n, v in x.scope.items() if v.kind == "node"}
            if whole and p.mode == "WALK":
                p = replace(p, mode="TRAIL")
            g = self.path(p, asked - held, walked[n] if whole else None)  # what is bound already brings its properties along
            f = g if f is None else self.merge(f, g, "inner")
        if whole:  # repetitions bind any number of edges: all edges of the match as one list
            f = Frame(f.df.withColumn("_edges", F.concat(*walked)).where(F.size(F.array_distinct("_edges")) == F.size("_edges")).drop("_edges", *walked), f.scope)
        elif m.different_edges:
            f = self.different(f, [i.var for i in path_items(m.paths) if isinstance(i, A.Edge)])
        if given is None:
            if m.optional:
                return self.merge(self.one_row(), self.where(f, m.where), "left")
            f = self.where(f, m.where)
        elif m.optional:
            outer = set(given.scope) - set(f.scope)
            across = [c for c in conjuncts(m.where) if names_in(c) & outer]
            for c in conjuncts(m.where):
                if c not in across:
                    f = self.where(f, c)
            f = self.merge(given, f, "left", across)
        else:
            f = self.where(self.merge(given, f, "inner"), m.where)
        if m.yields:
            return Frame(f.df, {n: f.scope[n] for n in (*(given.scope if given else ()), *m.yields)})
        return f

    @staticmethod
    def hoisted(m: A.Match, outer: set[str]) -> A.Match:
        """Conditions inside elements that use variables from around the pattern become part of WHERE."""
        moved: list[A.Expr] = []

        def lifted(i: A.Node | A.Edge | A.Group) -> A.Node | A.Edge | A.Group:
            if isinstance(i, A.Group):
                if (i.low, i.high) == (1, 1) and i.path.mode == "WALK" and not i.path.alternatives:
                    return replace(i, path=replace(i.path, items=[lifted(x) for x in i.path.items]))
                return i
            if isinstance(i, A.Edge) and i.low is not None:
                return i
            props = [(k, e) for k, e in i.props if not names_in(e) & outer]
            tests = conjuncts(i.where)
            here = [c for c in tests if not names_in(c) & outer]
            if len(props) == len(i.props) and len(here) == len(tests):
                return i
            moved.extend(A.Expr("=", [A.Expr("prop", [A.Expr("var", [i.var]), k]), e]) for k, e in i.props if names_in(e) & outer)
            moved.extend(c for c in tests if names_in(c) & outer)
            return replace(i, props=props, where=reduce(lambda x, y: A.Expr("and", [x, y]), here) if here else None)

        paths = [p if p.alternatives or p.search != ("ALL", 0) else replace(p, items=[lifted(i) for i in p.items]) for p in m.paths]
        return replace(m, paths=paths, where=reduce(lambda x, y: A.Expr("and", [x, y]), [*moved, *conjuncts(m.where)])) if moved else m

    def different(self, f: Frame, edges: list[str]) -> Frame:
        df = f.df
        plain = [e for e in edges if f.scope[e].kind == "edge"]
        for i, a in enumerate(plain):
            for b in plain[i + 1 :]:
                if set(f.scope[a].labels) & set(f.scope[b].labels):
                    df = df.where((F.col(f"{a}${EID}") != F.col(f"{b}${EID}")) | (F.col(f"{a}${LABEL}") != F.col(f"{b}${LABEL}")))
        return Frame(df, f.scope)

    def merge(self, a: Frame, b: Frame, how: str, across: list[A.Expr] | None = None) -> Frame:
        """Joins two frames on the variables that they share, by identity."""
        common = [n for n in b.scope if n in a.scope]
        right, on, drop, keys = b.df, [], [], []
        for n in common:
            mine = a.columns(n)
            for c in b.columns(n):
                if c in mine:  # a property that only the right side has brought along keeps its name
                    right = right.withColumnRenamed(c, f"_r${c}")
                    drop.append(f"_r${c}")
            ids = {"node": (VID, LABEL), "edge": (EID, LABEL)}.get(a.scope[n].kind)
            several = len(set(a.scope[n].labels) | set(b.scope[n].labels)) > 1
            for c in [f"{n}${x}" for x in (ids if several else ids[:1])] if ids else [n]:
                on.append(F.col(self.tick(c)) == F.col(self.tick(f"_r${c}")))
                keys.append(f"_r${c}")
        scope = a.scope | {n: v for n, v in b.scope.items() if n not in a.scope}
        for n in common:
            scope[n] = replace(a.scope[n], props=(*a.scope[n].props, *[p for p in b.scope[n].props if p not in a.scope[n].props]))
        if across:
            both = Frame(a.df.crossJoin(right), scope)
            on += [self.col(c, both) for c in across]
        if how in ("left_semi", "left_anti"):
            if not across:
                right = right.select(*[self.tick(k) for k in keys]).distinct() if keys else right.limit(1)
            return Frame(a.df.join(right, reduce(lambda x, y: x & y, on) if on else F.lit(True), how), a.scope)
        if not on:
            df = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        else:
            df = a.df.join(right, reduce(lambda x, y: x & y, on), how)
        return Frame(df.drop(*drop), scope)

    def where(self, f: Frame, e: A.Expr | None) -> Frame:
        for c in conjuncts(e):
            inner, negated = (c.args[0], True) if c.op == "not" else (c, False)
            if inner.op == "exists":
                f = self.semi(f, inner.args[0], "left_anti" if negated else "left_semi")
                continue
            names = {x for x in f.df.columns if x.startswith("_exists")}
            f = self.with_flags(f, [c])
            f = Frame(f.df.where(self.col(c, f)), f.scope)
            f = Frame(f.df.drop(*[x for x in f.df.columns if x.startswith("_exists") and x not in names]), f.scope)
        return f

    def with_flags(self, f: Frame, exprs: list[A.Expr]) -> Frame:
        """A column for each EXISTS in the expressions."""
        for x in (x for e in exprs for x in e.walk() if x.op == "exists"):
            f = self.flagged(f, x)
        return f

    def semi(self, f: Frame, m: A.Match, how: str) -> Frame:
        """The rows for which the pattern is found (or isn't): variables that both sides bind are join keys, conditions over
        both sides are part of the join."""
        m = self.hoisted(m, set(f.scope) - pattern_vars(m))
        refs = wanted([m])
        g = self.match(replace(m, where=None, optional=False), None, refs)
        outer = set(f.scope) - set(g.scope)
        across = [c for c in conjuncts(m.where) if names_in(c) & outer]
        for c in conjuncts(m.where):
            if c not in across:
                g = self.where(g, c)
        if not any(x.op == "exists" for c in across for x in c.walk()):
            return self.merge(f, Frame(g.df, {n: v for n, v in g.scope.items() if v.kind in ("node", "edge", "value")}), how, across)
        # an EXISTS inside a condition over both sides: found rows, by what they use from around
        used = [n for n in f.scope if n in set(g.scope).union(*[names_in(c) for c in across])]
        keys = [k for n in used for k in self.key_columns(f, n)]
        rows = Frame(f.df.select(*[self.tick(c) for n in used for c in f.columns(n)]).dropDuplicates(keys), {n: f.scope[n] for n in used})
        hit = self.merge(rows, g, "inner")
        for c in across:
            hit = self.where(hit, c)
        right = hit.df.select(*[F.col(self.tick(k)).alias(f"_x${k}") for k in keys]).distinct()
        return Frame(f.df.join(right, reduce(lambda x, y: x & y, [F.col(self.tick(k)).eqNullSafe(F.col(self.tick(f"_x${k}"))) for k in keys]), how), f.scope)

    def flagged(self, f: Frame, x: A.Expr) -> Frame:
        """A column that tells for each row whether the pattern is found; decided once for all rows that look alike to it."""
        m = x.args[0]
        self.fresh += 1
        x.text = flag = f"_exists{self.fresh}"
        used = [n for n in f.scope if n in names_in(x)]
        keys = [k for n in used for k in self.key_columns(f, n)]
        if not keys:
            found = self.match(m, None, wanted([m])).df.limit(1).agg((F.count("*") > 0).alias(flag))
            return Frame(f.df.crossJoin(F.broadcast(found)), f.scope)
        rows = Frame(f.df.select(*[self.tick(c) for n in used for c in f.columns(n)]).dropDuplicates(keys), {n: f.scope[n] for n in used})
        right = self.semi(rows, m, "left_semi").df.select(*[F.col(self.tick(k)).alias(f"_x${k}") for k in keys], F.lit(True).alias("_flag"))
        df = f.df.join(right, reduce(lambda a, b: a & b, [F.col(self.tick(k)).eqNullSafe(F.col(self.tick(f"_x${k}"))) for k in keys]), "left")
        return Frame(df.withColumn(flag, F.col("_flag").isNotNull()).drop("_flag", *[f"_x${k}" for k in keys]), f.scope)

    # -- elements
    def node_frame(self, n: A.Node) -> Frame:
        labels = labels_of(n.label, self.graph.vertices)
        if not labels:
            if n.label is not None and n.label.op == "label":
                raise BindFault(f"graph {self.graph.name} has no vertex label {n.label.args[0]}")
            return Frame(self.spark.createDataFrame([], f"`{n.var}${VID}` long, `{n.var}${LABEL}` string"), {n.var: Var("node")})
        df = None
        props: dict[str, None] = {}
        for label in labels:
            v = self.graph.vertices[label]
            props |= dict.fromkeys(v.properties)
            one = v.df.select(F.col(VID).alias(f"{n.var}${VID}"), F.lit(label).alias(f"{n.var}${LABEL}"), *[F.col(self.tick(p)).alias(f"{n.var}${p}") for p in v.properties])
            df = one if df is None else df.unionByName(one, allowMissingColumns=True)
        return self.inner_tests(Frame(df, {n.var: Var("node", tuple(labels), tuple(props))}), n)

    def inner_tests(self, f: Frame, n: A.Node | A.Edge) -> Frame:
        for key, e in n.props:
            f = Frame(f.df.where(self.col(A.Expr("=", [A.Expr("prop", [A.Expr("var", [n.var]), key]), e]), f)), f.scope)
        if n.where is not None and names_in(n.where) <= {n.var}:
            f = self.where(f, n.where)
        return f

    def edge_frame(self, e: A.Edge, sources: Iterable[str], targets: Iterable[str]) -> Frame:
        """Edges as _fl, _f (label and id of where one comes from), _tl, _t, and the variable's columns."""
        known = [s.label for s in self.graph.edges]
        labels = labels_of(e.label, known)
        if e.label is not None and e.label.op == "label" and not labels:
            raise BindFault(f"graph {self.graph.name} has no edge label {e.label.args[0]}")
        sources, targets = set(sources), set(targets)
        df, props = None, {}
        for s in self.graph.edges:
            if s.label not in labels:
                continue
            for way in ("out", "in"):
                if e.direction not in (way, "any"):
                    continue
                fl, tl = (s.src_label, s.dst_label) if way == "out" else (s.dst_label, s.src_label)
                if fl not in sources or tl not in targets:
                    continue
                props |= dict.fromkeys(s.properties)
                one = self._oriented(s, e.var, way, fl, tl)
                if e.direction == "any" and way == "in" and s.src_label == s.dst_label:
                    one = one.where(F.col("_f") != F.col("_t"))  # a loop counts once
                df = one if df is None else df.unionByName(one, allowMissingColumns=True)
        scope = {e.var: Var("edge", tuple(labels), tuple(props))}
        if df is None:
            cols = ", ".join(f"`{c}` {t}" for c, t in [("_fl", "string"), ("_f", "long"), ("_tl", "string"), ("_t", "long"), (f"{e.var}${EID}", "long"), (f"{e.var}${LABEL}", "string"), (f"{e.var}${SRC}", "long"), (f"{e.var}${DST}", "long"), (f"{e.var}$_src_label", "string"), (f"{e.var}$_dst_label", "string")])
            return Frame(self.spark.createDataFrame([], cols), scope)
        return self.inner_tests(Frame(df, scope), e)

    def host_of(self, e: A.Edge, sources: Iterable[str], targets: Iterable[str], end: str) -> EdgeSet | None:
        """The one edge set of a fixed edge whose rows hold the vertices at `end` (from or to) as well, if there is one."""
        if e.low is not None or e.direction == "any" or not self.graph.closed:
            return None
        a, b = ("src_label", "dst_label") if e.direction == "out" else ("dst_label", "src_label")
        labels = set(labels_of(e.label, [s.label for s in self.graph.edges]))
        found = [s for s in self.graph.edges if s.label in labels and getattr(s, a) in set(sources) and getattr(s, b) in set(targets)]
        side = {("out", "from"): "src", ("out", "to"): "dst", ("in", "from"): "dst", ("in", "to"): "src"}[e.direction, end]
        return found[0] if len(found) == 1 and found[0].host == side else None

    def hosted_frame(self, s: EdgeSet, e: A.Edge, n: A.Node, end: str) -> Frame:
        """Edges and the vertices n at one end from one scan; columns as in edge_frame, and n's."""
        fl, tl, a, b = (s.src_label, s.dst_label, SRC, DST) if e.direction == "out" else (s.dst_label, s.src_label, DST, SRC)
        label, vid = (fl, a) if end == "from" else (tl, b)
        props = self.graph.vertices[label].properties
        df = s.hosted().select(
            F.lit(fl).alias("_fl"), F.col(a).alias("_f"), F.lit(tl).alias("_tl"), F.col(b).alias("_t"),
            F.col(EID).alias(f"{e.var}${EID}"), F.lit(s.label).alias(f"{e.var}${LABEL}"), F.col(SRC).alias(f"{e.var}${SRC}"), F.col(DST).alias(f"{e.var}${DST}"),
            F.lit(s.src_label).alias(f"{e.var}$_src_label"), F.lit(s.dst_label).alias(f"{e.var}$_dst_label"), *[F.col(self.tick(p)).alias(f"{e.var}${p}") for p in s.properties],
            F.col(vid).alias(f"{n.var}${VID}"), F.lit(label).alias(f"{n.var}${LABEL}"), *[F.col(self.tick(p)).alias(f"{n.var}${p}") for p in props])
        f = Frame(df, {n.var: Var("node", (label,), tuple(props)), e.var: Var("edge", (s.label,), tuple(s.properties))})
        return self.inner_tests(self.inner_tests(f, e), n)

    def _oriented(self, s: EdgeSet, var: str, way: str, fl: str, tl: str) -> DataFrame:
        a, b = (SRC, DST) if way == "out" else (DST, SRC)
        return s.df.select(
            F.lit(fl).alias("_fl"), F.col(a).alias("_f"), F.lit(tl).alias("_tl"), F.col(b).alias("_t"),
            F.col(EID).alias(f"{var}${EID}"), F.lit(s.label).alias(f"{var}${LABEL}"), F.col(SRC).alias(f"{var}${SRC}"), F.col(DST).alias(f"{var}${DST}"),
            F.lit(s.src_label).alias(f"{var}$_src_label"), F.lit(s.dst_label).alias(f"{var}$_dst_label"), *[F.col(self.tick(p)).alias(f"{var}${p}") for p in s.properties])

    # -- paths
    def path(self, p: A.Path, refs: set[str] | None, edges: str | None = None) -> Frame:
        """`edges` names a column that keeps the list of the path's edges."""
        if p.alternatives:
            frames = [self.path(replace(x, mode=p.mode, var=p.var, search=p.search), None, edges) for x in p.alternatives]
            names = list(dict.fromkeys(n for f in frames for n in f.scope if all(n in g.scope for g in frames) or not n.startswith("_")))
            scope = {}
            for n in names:
                have = [f.scope[n] for f in frames if n in f.scope]
                scope[n] = replace(have[0], labels=tuple(dict.fromkeys(x for v in have for x in v.labels)), props=tuple(dict.fromkeys(x for v in have for x in v.props)))
            df = None
            for f in frames:
                cols = [c for n in names if n in f.scope for c in f.columns(n)]
                one = f.df.select(*[self.tick(c) for c in cols], *([edges] if edges else []))
                df = one if df is None else df.unionByName(one, allowMissingColumns=True)
            return Frame(df if p.multiset else df.distinct(), scope)
        search, k = p.search
        items = self.spliced(p.items)
        track = p.var is not None or p.mode != "WALK" or search != "ALL" or edges is not None
        single = len(items) == 3 and isinstance(items[1], A.Edge) and items[1].low is not None
        shortest = search if "SHORTEST" in search and single and p.mode == "WALK" and (k == 1 or search == "ALL SHORTEST") else ""
        f = self.walk(items, refs, track, p.mode, shortest)
        if track:
            f = self.restricted(f, p.mode)
        if search != "ALL" and shortest != "ALL SHORTEST":  # of its levels one alone reaches a vertex from a start
            ends = [i for i in items if isinstance(i, A.Node)]
            f = self.searched(f, search, k, ends[0].var, ends[-1].var)
        if p.var is not None:
            f = Frame(f.df.withColumn(p.var, F.struct(F.col("_pn").alias("nodes"), F.col("_pe").alias("edges"))), f.scope | {p.var: Var("path")})
        return Frame((f.df.withColumnRenamed("_pe", edges) if edges else f.df).drop("_pn", "_pe"), f.scope)

    def spliced(self, items: list) -> list:
        """Parenthesised subpaths that occur once become part of the path around them."""
        out: list = []
        for i in items:
            if isinstance(i, A.Group) and (i.low, i.high) == (1, 1) and not i.path.alternatives and i.path.mode == "WALK":
                inner = self.spliced(i.path.items)
                if i.where is not None:
                    inner[-1] = A.Group(A.Path([inner[-1]]), 1, 1, i.where)
                out += inner
            else:
                out.append(i)
        return out

    def walk(self, items: list, refs: set[str] | None, track: bool, mode: str, shortest: str) -> Frame:
        need = lambda n: refs is None or n.var in refs or bool(n.props) or n.where is not None or not self.graph.closed
        f: Frame | None = None
        here: str | None = None
        late: list[A.Expr] = []
        pending: A.Node | None = None
        k = 0
        while k < len(items):
            i = items[k]
            if isinstance(i, A.Group) and (i.low, i.high) == (1, 1) and i.where is not None and len(i.path.items) == 1:
                late.append(i.where)
                i = i.path.items[0]
            if isinstance(i, A.Node):
                if i.where is not None and not names_in(i.where) <= {i.var}:
                    late.append(i.where)
                if f is None:
                    nxt = items[k + 1] if k + 1 < len(items) else None
                    after = items[k + 2] if k + 2 < len(items) and isinstance(items[k + 2], A.Node) else None
                    host = nxt is not None and isinstance(nxt, A.Edge) and after is not None and after.var != i.var and self.host_of(nxt, labels_of(i.label, self.graph.vertices), labels_of(after.label, self.graph.vertices), "from")
                    if isinstance(nxt, A.Edge) and nxt.low is None and (not need(i) or host):
                        pending = i
                    else:
                        f = self.node_frame(i)
                        if track:
                            f = Frame(f.df.withColumn("_pn", F.array(self.ref(i.var, VID))).withColumn("_pe", F.expr("cast(array() as array<struct<label:string,id:bigint>>)")), f.scope)
                else:  # directly after another node: the same vertex
                    g = self.node_frame(i)
                    df = f.df.join(g.df, (F.col(f"{here}${VID}") == F.col(f"{i.var}${VID}")) & (F.col(f"{here}${LABEL}") == F.col(f"{i.var}${LABEL}")))
                    f = Frame(df, f.scope | g.scope)
                here = i.var
                k += 1
                continue
            target = items[k + 1] if k + 1 < len(items) and isinstance(items[k + 1], A.Node) else A.Node(f"_t{k}", named=False)
            if isinstance(i, A.Edge) and i.where is not None and not names_in(i.where) <= {i.var}:
                late.append(i.where)
            if target.where is not None and not names_in(target.where) <= {target.var}:
                late.append(target.where)
            if isinstance(i, A.Edge) and i.low is None:
                f = self.step(f, pending, here, i, target, need(target), track, pending is not None and need(pending))
            else:
                f = self.repeated(f, here, i, target, need(target), track, mode, shortest)
            pending, here = None, target.var
            k += 2 if k + 1 < len(items) and target is items[k + 1] else 1
        if f is None:
            f = self.node_frame(pending)
        for e in late:
            f = self.where(f, e)
        return f

    @staticmethod
    def ref(var: str, what: str) -> Column:
        return F.struct(F.col(f"{var}${LABEL}").alias("label"), F.col(f"{var}${what}").cast("long").alias("id"))

    def step(self, f: Frame | None, pending: A.Node | None, here: str, e: A.Edge, t: A.Node, need: bool, track: bool, first: bool = False) -> Frame:
        """One edge: an equi-join on the end where it begins and, where something is asked of the target, one on the other.
        `first`: something is asked of the pending first vertex, and the edge's rows hold it."""
        sources = labels_of(pending.label, self.graph.vertices) if pending is not None else f.scope[here].labels
        bound = f is not None and t.var in f.scope or pending is not None and t.var == here
        targets = (f.scope[t.var].labels if f is not None and t.var in f.scope else sources) if bound else labels_of(t.label, self.graph.vertices)
        if bound and t.label is not None:
            targets = labels_of(t.label, targets)
        host = self.host_of(e, sources, targets, "to") if need and not bound and (f is None or e.var not in f.scope) else None
        if first:
            g = self.hosted_frame(self.host_of(e, sources, targets, "from"), e, pending, "from")
        elif host is not None:
            g = self.hosted_frame(host, e, t, "to")
        else:
            g = self.edge_frame(e, sources, targets)
        if f is None:
            if first:
                df, scope = g.df, g.scope
            else:
                df = g.df.withColumn(f"{here}${VID}", F.col("_f")).withColumn(f"{here}${LABEL}", F.col("_fl"))
                scope = {here: Var("node", tuple(sources))} | g.scope
            if track:
                df = df.withColumn("_pn", F.array(self.ref(here, VID))).withColumn("_pe", F.expr("cast(array() as array<struct<label:string,id:bigint>>)"))
        else:
            on = F.col(f"{here}${VID}") == F.col("_f")
            if len(f.scope[here].labels) > 1:
                on = on & (F.col(f"{here}${LABEL}") == F.col("_fl"))
            clash = e.var in f.scope
            if clash:  # the same edge again
                gd = g.df.select("_fl", "_f", "_tl", "_t", F.col(f"{e.var}${EID}").alias("_same"), F.col(f"{e.var}${LABEL}").alias("_same_label"))
                df = f.df.join(gd, on & (F.col("_same") == F.col(f"{e.var}${EID}")) & (F.col("_same_label") == F.col(f"{e.var}${LABEL}"))).drop("_same", "_same_label")
                scope = f.scope
            else:
                df, scope = f.df.join(g.df, on), f.scope | g.scope
        out = Frame(df, scope) if host is not None and not first else self.arrive(Frame(df, scope), t, bound, need, targets, ("_tl", "_t"))
        df = out.df
        if track:
            df = df.withColumn("_pe", F.concat("_pe", F.array(self.ref(e.var, EID)))).withColumn("_pn", F.concat("_pn", F.array(self.ref(t.var, VID))))
        return Frame(df.drop("_fl", "_f", "_tl", "_t"), out.scope)

    def arrive(self, f: Frame, t: A.Node, bound: bool, need: bool, targets: Iterable[str], at: tuple[str, str]) -> Frame:
        label, vid = F.col(at[0]), F.col(at[1])
        if bound:
            df = f.df.where((F.col(f"{t.var}${VID}") == vid) & (F.col(f"{t.var}${LABEL}") == label))
            return self.inner_tests(Frame(df, f.scope), t)
        if need:
            g = self.node_frame(t)
            on = F.col(f"{t.var}${VID}") == vid
            if len(g.scope[t.var].labels) > 1:
                on = on & (F.col(f"{t.var}${LABEL}") == label)
            return Frame(f.df.join(g.df, on), f.scope | g.scope)
        return Frame(f.df.withColumn(f"{t.var}${VID}", vid).withColumn(f"{t.var}${LABEL}", label), f.scope | {t.var: Var("node", tuple(targets))})

    def hop(self, i: A.Edge | A.Group) -> DataFrame:
        """What one repetition adds: (_fl, _f, _tl, _t, _he: its edges, _hn: its vertices after the first)."""
        every = list(self.graph.vertices)
        if isinstance(i, A.Edge):
            g = self.edge_frame(i, every, every)
            return g.df.select("_fl", "_f", "_tl", "_t", F.array(self.ref(i.var, EID)).alias("_he"), F.array(F.struct(F.col("_tl").alias("label"), F.col("_t").cast("long").alias("id"))).alias("_hn"))
        items = self.spliced(i.path.items)
        f = self.restricted(self.walk(items, None, True, i.path.mode, ""), i.path.mode)
        f = self.where(f, i.where)
        nodes = [x.var for x in items if isinstance(x, A.Node)]
        a, b = nodes[0], nodes[-1]
        return f.df.select(F.col(f"{a}${LABEL}").alias("_fl"), F.col(f"{a}${VID}").alias("_f"), F.col(f"{b}${LABEL}").alias("_tl"), F.col(f"{b}${VID}").alias("_t"), F.col("_pe").alias("_he"), F.expr("slice(_pn, 2, greatest(size(_pn) - 1, 0))").alias("_hn"))

    def repeated(self, f: Frame, here: str, i: A.Edge | A.Group, t: A.Node, need: bool, track: bool, mode: str, shortest: str) -> Frame:
        """A quantified edge or subpath.  A fixed or small number of repetitions is a plan of joins.  Else they run level by
        level: each level is written once, carries the start, the current vertex and the path only, and the other columns meet
        the levels again at the end.  Unbounded ones follow trails (no edge twice), so they end.  For shortest paths a level
        leaves out what an earlier one has reached from the same start; where any shortest path will do, it keeps one a vertex.
        Starts that share their only way on share the search beyond it, too."""
        hop = self.hop(i)
        start = [f"{here}${LABEL}", f"{here}${VID}"]
        levels = bool(shortest) or i.high is None or i.high > max(i.low, UNROLLED)
        alone = set(f.df.columns) == set(start) and set(f.scope) == {here}
        base = f.df if not levels or set(f.scope) == {here} else written(f.df, "starts")
        first = base if alone or not levels else base.select(*start) if set(f.scope) == {here} else base.select(*start).distinct()
        found, shared = self.reached(first, start, hop, i.low, i.high, mode, shortest, levels)
        back = base.select(*[F.col(self.tick(c)).alias(f"_b{k}" if c in start else c) for k, c in [(start.index(c) if c in start else 0, c) for c in base.columns]])
        whole = lambda df: df if not levels or alone else df.join(back, (F.col(start[0]) == F.col("_b0")) & (F.col(start[1]) == F.col("_b1"))).drop("_b0", "_b1")
        bound = t.var in f.scope
        targets = f.scope[t.var].labels if bound else labels_of(t.label, self.graph.vertices)
        ending = lambda df: df.where(F.col("_cl").isin(list(targets))) if len(targets) < len(self.graph.vertices) else df
        at = ("_cl", "_cv")
        frames = []
        if found or shared is None:
            everything = reduce(DataFrame.unionByName, found) if found else first.limit(0).select("*", *self.standing(start))
            frames.append(self.arrive(Frame(ending(whole(everything)), f.scope), t, bound, need, targets, at))
        if shared is not None:
            near, far = shared
            far = ending(far)
            blocks = self.blocks(near, far)
            there = Frame(far, {}) if bound else self.arrive(Frame(far, {}), t, False, need, targets, at)
            df = self.expanded(whole(near), there.df, start, blocks)
            if i.low == 0:  # that path has no edges
                df = df.where((F.col(start[0]) != F.col("_cl")) | (F.col(start[1]) != F.col("_cv")))
            g = Frame(df, f.scope | there.scope)
            frames.append(self.arrive(g, t, True, need, targets, at) if bound else g)
        df, scope = reduce(DataFrame.unionByName, [x.df for x in frames]), frames[0].scope
        if track:
            df = df.withColumn("_pe", F.concat("_pe", "_qe")).withColumn("_pn", F.concat("_pn", "_qn"))
        if isinstance(i, A.Edge) and i.named:
            df, scope = df.withColumn(i.var, F.col("_qe")), scope | {i.var: Var("edges")}
        return Frame(df.drop("_cl", "_cv", "_qe", "_qn"), scope)

    @staticmethod
    def standing(start: list[str]) -> list[Column]:
        """Paths without edges: where they stand is where they began."""
        none = F.expr("cast(array() as array<struct<label:string,id:bigint>>)")
        return [F.col(start[0]).alias("_cl"), F.col(start[1]).alias("_cv"), none.alias("_qe"), none.alias("_qn")]

    def reached(self, first: DataFrame, start: list[str], hop: DataFrame, low: int, high: int | None, mode: str, shortest: str, levels: bool, share: bool = True) -> tuple[list[DataFrame], tuple[DataFrame, DataFrame] | None]:
        """Levels of (start, _cl, _cv, _qe, _qn); for starts that share a search, their first edge and what is found beyond it."""
        level = first.select("*", *self.standing(start))
        trail = mode == "TRAIL" or high is None and not shortest
        found = [level] if low == 0 else []
        seen = [level] if shortest and low == 0 else []
        shared = None
        depth = 0
        while high is None or depth < high:
            depth += 1
            level = level.join(hop, (F.col("_cv") == F.col("_f")) & (F.col("_cl") == F.col("_fl")))
            if trail:
                level = level.where(~F.arrays_overlap("_qe", "_he"))
            if mode in ("ACYCLIC", "SIMPLE"):
                level = level.where(~F.arrays_overlap("_qn", "_hn"))
            level = level.withColumn("_qe", F.concat("_qe", "_he")).withColumn("_qn", F.concat("_qn", "_hn")).withColumn("_cl", F.col("_tl")).withColumn("_cv", F.col("_t")).drop("_fl", "_f", "_tl", "_t", "_he", "_hn")
            if seen:
                known = reduce(DataFrame.union, [x.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate((*start, "_cl", "_cv"))]) for x in seen])
                level = level.join(known, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_s{k}") for k, c in enumerate((*start, "_cl", "_cv"))]), "left_anti")
            if shortest == "SHORTEST":
                level = level.groupBy(*start, "_cl", "_cv").agg(F.min(F.struct("_qe", "_qn")).alias("_way")).select(*start, "_cl", "_cv", "_way._qe", "_way._qn")
            if levels:
                level = written(level, "level")
                steps = level.limit(SHARED).count()
                if not steps:
                    break
                if shortest and share and depth == 1 and high != 1 and steps == SHARED:
                    near, level = self.sharing(level, start)
                    if near is not None:
                        hubs = written(near.select(F.col("_cl").alias("_xl"), F.col("_cv").alias("_xv")).distinct(), "hubs")
                        beyond, _ = self.reached(hubs, ["_xl", "_xv"], hop, max(low - 1, 0), None if high is None else high - 1, mode, shortest, levels, share=False)
                        if beyond:
                            shared = near, reduce(DataFrame.unionByName, beyond)
                    if level is None:
                        break
            if depth >= low:
                found.append(level)
                if shortest:
                    seen = [*seen, level] if len(seen) < 16 else [written(reduce(DataFrame.unionByName, [x.select(*start, "_cl", "_cv") for x in [*seen, level]]), "seen")]
        return found, shared

    @staticmethod
    def sharing(level: DataFrame, start: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """A first level in two, of which one may be missing: starts with one way on, if that leads to half as many vertices or fewer,
        and the others.  A shortest path of the former is their edge and a shortest path from where it leads."""
        ways = level.groupBy(*start).agg(F.min(F.struct("_cl", "_cv")).alias("_x"), F.max(F.struct("_cl", "_cv")).alias("_y"))
        lone = F.col("_x") == F.col("_y")
        n = ways.agg(F.count("*").alias("starts"), F.count_if(lone).alias("lone"), F.count_distinct(F.when(lone, F.col("_x"))).alias("hubs")).first()
        if n["lone"] < 2 * n["hubs"] or not n["lone"]:
            return None, level
        if n["lone"] == n["starts"]:
            return level, None
        part = lambda test: written(level.join(ways.where(test).select(*start), start, "left_semi").select(*level.columns), "level")
        return part(lone), part(~lone)

    @staticmethod
    def blocks(near: DataFrame, far: DataFrame) -> tuple[DataFrame, int] | None:
        """(_hl, _hv, _blocks) and a number of partitions, where starts and what lies beyond a shared vertex make many pairs:
        the starts of a vertex are dealt into blocks of so many pairs, though of 16 starts at least, as each meets a copy of the rest."""
        sizes = near.groupBy(F.col("_cl").alias("_hl"), F.col("_cv").alias("_hv")).agg(F.count("*").alias("_n"))
        sizes = sizes.join(far.groupBy("_xl", "_xv").agg(F.count("*").alias("_m")), (F.col("_hl") == F.col("_xl")) & (F.col("_hv") == F.col("_xv")))
        sizes = written(sizes.select("_hl", "_hv", (F.col("_n").cast("double") * F.col("_m")).alias("_pairs"), F.greatest(F.lit(1), F.least(F.ceil(F.col("_n").cast("double") * F.col("_m") / PAIRS), F.floor(F.col("_n") / 16))).cast("int").alias("_blocks")), "blocks")
        pairs = sizes.agg(F.sum("_pairs")).first()[0] or 0
        return (sizes.drop("_pairs"), min(int(pairs / (4 * PAIRS)) + 1, 10000)) if pairs > PAIRS else None

    @staticmethod
    def expanded(near: DataFrame, far: DataFrame, start: list[str], blocks: tuple[DataFrame, int] | None) -> DataFrame:
        """Every start with everything beyond its first edge."""
        near = near.withColumnRenamed("_cl", "_nl").withColumnRenamed("_cv", "_nv").withColumnRenamed("_qe", "_ne").withColumnRenamed("_qn", "_nn")
        on = (F.col("_nl") == F.col("_xl")) & (F.col("_nv") == F.col("_xv"))
        if blocks is not None:
            sizes, n = blocks
            at = lambda l, v: (F.col(l) == F.col("_hl")) & (F.col(v) == F.col("_hv"))
            near = near.join(sizes, at("_nl", "_nv")).withColumn("_block", F.pmod(F.xxhash64(*start), F.col("_blocks")).cast("int")).drop("_hl", "_hv", "_blocks").repartition(n, "_nl", "_nv", "_block")
            far = far.join(sizes, at("_xl", "_xv")).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_hl", "_hv", "_blocks")
            on = on & (F.col("_block") == F.col("_copy"))
            far = far.hint("merge")  # a block's rows are read on end; looked up in a broadcast table they take three times as long
        df = near.join(far, on).withColumn("_qe", F.concat("_ne", "_qe")).withColumn("_qn", F.concat("_nn", "_qn"))
        return df.drop("_nl", "_nv", "_ne", "_nn", "_xl", "_xv", "_block", "_copy")

    def restricted(self, f: Frame, mode: str) -> Frame:
        once = lambda c: F.size(F.array_distinct(c)) == F.size(c)
        if mode == "TRAIL":
            return Frame(f.df.where(once("_pe")), f.scope)
        if mode == "ACYCLIC":
            return Frame(f.df.where(once("_pn")), f.scope)
        if mode == "SIMPLE":  # only the first and the last vertex may be the same
            return Frame(f.df.where(once("_pn") | (once(F.expr("slice(_pn, 2, greatest(size(_pn) - 1, 0))")) & (F.element_at("_pn", 1) == F.element_at("_pn", -1)))), f.scope)
        return f

    def searched(self, f: Frame, search: str, k: int, a: str, b: str) -> Frame:
        by = Window.partitionBy(f"{a}${LABEL}", f"{a}${VID}", f"{b}${LABEL}", f"{b}${VID}")
        size = F.size("_pe")
        rank = {"ALL SHORTEST": F.rank().over(by.orderBy(size)), "SHORTEST GROUP": F.dense_rank().over(by.orderBy(size))}.get(search)
        if rank is None:
            rank = F.row_number().over(by.orderBy(size, "_pe"))
        return Frame(f.df.withColumn("_rank", rank).where(F.col("_rank") <= (1 if search == "ALL SHORTEST" else k)).drop("_rank"), f.scope)

    # -- counting without enumerating
    def counted(self, parts: list) -> Frame | None:
        """MATCH of one plain path and RETURN count(*): counts are folded along the path, so no match is ever built.

        Each vertex carries the number of partial paths that end there; a hop is a join with edges and a sum by target.
        """
        if len(parts) != 2 or not isinstance(parts[1], A.Return):
            return None
        m, r = parts
        if m.optional or m.where is not None or m.different_edges or m.yields or len(m.paths) != 1 or r.star or r.group is not None or r.having is not None or r.order or len(r.items) != 1 or r.distinct:
            return None
        e = r.items[0][0]
        p = m.paths[0]
        if e.op != "agg" or e.args[0] != "COUNT" or e.args[1][0].op != "star" or p.mode != "WALK" or p.search != ("ALL", 0) or p.alternatives or len(p.items) < 3:
            return None
        names = [i.var for i in p.items if not isinstance(i, A.Group)]
        if len(set(names)) != len(p.items) or any(isinstance(i, A.Group) or isinstance(i, A.Edge) and i.low is not None or i.where is not None for i in p.items):
            return None
        if not all(isinstance(i, A.Node if k % 2 == 0 else A.Edge) for k, i in enumerate(p.items)):
            return None
        nodes, edges = p.items[::2], p.items[1::2]
        plain = lambda n: not n.props and self.graph.closed
        label_sets = [labels_of(n.label, self.graph.vertices) for n in nodes]
        ways: DataFrame | None = None
        for k, edge in enumerate(edges):
            g = self.edge_frame(edge, label_sets[k], label_sets[k + 1]).df.select("_fl", "_f", "_tl", "_t")
            if k == 0 and not plain(nodes[0]):
                first = self.node_frame(nodes[0]).df.select(F.col(f"{nodes[0].var}${LABEL}").alias("_fl"), F.col(f"{nodes[0].var}${VID}").alias("_f"))
                g = g.join(first, ["_fl", "_f"], "left_semi")
            if not plain(nodes[k + 1]):
                last = self.node_frame(nodes[k + 1]).df.select(F.col(f"{nodes[k + 1].var}${LABEL}").alias("_tl"), F.col(f"{nodes[k + 1].var}${VID}").alias("_t"))
                g = g.join(last, ["_tl", "_t"], "left_semi")
            g = g.withColumn("_w", F.lit(1).cast("long")) if ways is None else g.join(ways, ["_fl", "_f"])
            if k + 1 < len(edges):
                ways = g.groupBy("_tl", "_t").agg(F.sum("_w").alias("_w")).select(F.col("_tl").alias("_fl"), F.col("_t").alias("_f"), "_w")
            else:
                ways = g
        name = r.items[0][1]
        return Frame(ways.agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("long").alias(name)), {name: Var("value")})

    # ---------------------------------------------------------------- expressions
    def type_of(self, c: Column, f: Frame) -> T.DataType:
        return f.df.select(c.alias("x")).schema["x"].dataType

    def literal(self, v: object) -> Column:
        return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)

    def identity(self, e: A.Expr, f: Frame) -> tuple[Column, Column] | None:
        """Label and id, if the expression is a vertex or edge variable."""
        if e.op == "var" and e.args[0] in f.scope and f.scope[e.args[0]].kind in ("node", "edge"):
            n = e.args[0]
            return F.col(f"{n}${LABEL}"), F.col(f"{n}${VID if f.scope[n].kind == 'node' else EID}")
        return None

    def col(self, e: A.Expr, f: Frame) -> Column:  # noqa: C901
        op, a = e.op, e.args
        if op == "lit":
            return self.literal(a[0])
        if op == "param":
            if a[0] not in self.params:
                raise BindFault(f"parameter ${a[0]} isn't set")
            v = self.params[a[0]]
            return F.array(*[self.literal(x) for x in v]) if isinstance(v, (list, tuple)) else self.literal(v)
        if op == "user":
            return F.lit(self.user)
        if op == "var":
            v = f.scope.get(a[0])
            if v is None:
                raise BindFault(f"variable {a[0]} isn't bound")
            if v.kind in ("node", "edge"):
                return F.when(self.identity(e, f)[1].isNotNull(), F.struct(*[F.col(self.tick(c)).alias(c[len(a[0]) + 1 :]) for c in f.columns(a[0])]))
            return F.col(self.tick(a[0]))
        if op == "prop":
            if a[0].op == "var" and a[0].args[0] in f.scope and f.scope[a[0].args[0]].kind in ("node", "edge"):
                v = f.scope[a[0].args[0]]
                if a[1] not in v.props:
                    raise BindFault(f"{a[0].args[0]} has no property {a[1]}")
                return F.col(self.tick(f"{a[0].args[0]}${a[1]}"))
            return self.col(a[0], f)[a[1]]
        if op in ("and", "or"):
            x, y = self.col(a[0], f), self.col(a[1], f)
            return x & y if op == "and" else x | y
        if op == "xor":
            return self.col(a[0], f) != self.col(a[1], f)
        if op == "not":
            return ~self.col(a[0], f)
        if op == "neg":
            return -self.col(a[0], f)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            ids = [self.identity(x, f) for x in a]
            if all(ids):
                same = (ids[0][0] == ids[1][0]) & (ids[0][1] == ids[1][1])
                return same if op == "=" else ~same
            x, y = (self.col(v, f) for v in a)
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op in ("+", "-", "*", "/", "%"):
            x, y = (self.col(v, f) for v in a)
            kinds = [self.type_of(v, f) for v in (x, y)]
            if any(isinstance(t, (T.StringType, T.BooleanType)) for t in kinds):
                raise BindFault(f"{op} isn't defined for {kinds[0].simpleString()} and {kinds[1].simpleString()}")
            if op == "/" and all(isinstance(t, T.IntegralType) for t in kinds):
                return self.int_div(x, y)
            return {"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op]
        if op == "||":
            return F.concat(*[self.col(v, f) for v in a])
        if op == "in":
            if a[1].op == "list":
                return self.col(a[0], f).isin(*[self.col(v, f) for v in a[1].args])
            return F.array_contains(self.col(a[1], f), self.col(a[0], f))
        if op == "like":
            pattern = self.constant(a[1])
            return self.col(a[0], f).like(pattern.replace("\\", "\\\\"))
        if op == "is":
            return self.is_test(a, f)
        if op == "list":
            return F.array(*[self.col(v, f) for v in a])
        if op == "vector":
            return F.array(*[self.col(v, f).cast("float") for v in a])
        if op == "record":
            return F.struct(*[self.col(v, f).alias(k) for k, v in a])
        if op == "path":
            ids = [self.identity(v, f) for v in a]
            if not all(ids):
                raise BindFault("a path is made of vertices and edges")
            refs = [F.struct(x.alias("label"), y.alias("id")) for x, y in ids]
            return F.struct(F.array(*refs[::2]).alias("nodes"), F.array(*refs[1::2]).alias("edges"))
        if op == "at":
            return F.get(self.col(a[0], f), self.col(a[1], f))
        if op == "temporal":
            return self.temporal(*a)
        if op == "cast":
            return self.col(a[0], f).cast(spark_type(a[1]))
        if op == "case":
            return self.case(a, f)
        if op == "exists":
            if not e.text.startswith("_exists"):
                raise BindFault("EXISTS belongs in a condition")
            return F.col(e.text)
        if op == "agg":
            return self.aggregate(a, f)
        if op == "call":
            return self.function(a[0], a[1], f)
        raise BindFault(f"{op} can't stand here")

    @staticmethod
    def int_div(x: Column, y: Column) -> Column:
        """Integer division, truncating; an error where the divisor is 0."""
        return F.call_function("div", x, y)

    def is_test(self, a: list, f: Frame) -> Column:
        kind = a[0]
        ids = self.identity(a[1], f)
        if kind in ("NULL", "UNKNOWN"):
            return ids[1].isNull() if ids else self.col(a[1], f).isNull()
        if kind in ("TRUE", "FALSE"):
            return self.col(a[1], f).eqNullSafe(F.lit(kind == "TRUE"))
        if kind == "TYPED":
            return F.lit(self.type_of(self.col(a[1], f), f).simpleString() == spark_type(a[2]))
        if ids is None:
            raise BindFault(f"IS {kind} is for vertices and edges")
        if kind == "LABELED":
            return ids[0].isin(labels_of(a[2], f.scope[a[1].args[0]].labels))
        if kind == "DIRECTED":
            return F.lit(True)
        end, label = (SRC, "_src_label") if kind == "SOURCE" else (DST, "_dst_label")
        return (F.col(f"{a[2]}${end}") == ids[1]) & (F.col(f"{a[2]}${label}") == ids[0])

    def case(self, a: list, f: Frame) -> Column:
        operand, whens, other = a
        out = None
        for cond, value in whens:
            c = self.col(cond, f) if operand is None else self.col(operand, f) == self.col(cond, f)
            v = self.col(value, f)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(self.col(other, f)) if other is not None else out

    def temporal(self, kind: str, text: str) -> Column:
        if kind == "DATE":
            return F.to_date(F.lit(text))
        if kind in ("DATETIME", "TIMESTAMP"):
            return F.to_timestamp(F.lit(text)) if text.endswith("Z") or "+" in text[10:] else F.to_timestamp_ntz(F.lit(text))
        if kind == "TIME":
            return F.lit(text)
        import re

        m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
        if not m:
            raise BindFault(f"{text} isn't a duration")
        sign = -1 if m[1] else 1
        y, mo, d, h, mi = (sign * int(x or 0) for x in m.groups()[1:6])
        if y or mo:
            return F.make_ym_interval(F.lit(y), F.lit(mo))
        return F.make_dt_interval(F.lit(d), F.lit(h), F.lit(mi), F.lit(sign * float(m[7] or 0)).cast("decimal(18,6)"))

    def aggregate(self, a: list, f: Frame) -> Column:
        name, args, distinct = a
        if args[0].op == "star":
            return F.count(F.lit(1))
        ids = self.identity(args[0], f)
        if name == "COUNT":
            c = (F.struct(ids[0].alias("l"), ids[1].alias("i")) if distinct else ids[1]) if ids else self.col(args[0], f)
            return F.count_distinct(F.when(ids[1].isNotNull(), c) if ids else c) if distinct else F.count(c)
        c = self.col(args[0], f)
        if name == "SUM":
            kind = self.type_of(c, f)
            c = c.cast("long") if isinstance(kind, T.IntegralType) else c.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType)) else c
            return F.sum_distinct(c) if distinct else F.sum(c)
        if name == "AVG":
            return self._distinct_avg(c) if distinct else F.avg(c.cast("double"))
        if name in ("MIN", "MAX"):
            return (F.min if name == "MIN" else F.max)(c)
        if name == "COLLECT_LIST":
            return F.collect_set(c) if distinct else F.collect_list(c)
        if name in ("STDDEV_SAMP", "STDDEV_POP"):
            return (F.stddev_samp if name == "STDDEV_SAMP" else F.stddev_pop)(c)
        share = self.constant(args[1])
        return F.percentile(c, share) if name == "PERCENTILE_CONT" else self._percentile_disc(c, share)

    @staticmethod
    def _distinct_avg(c: Column) -> Column:
        return F.sum_distinct(c.cast("double")) / F.nullif(F.count_distinct(c.cast("double")), F.lit(0))

    @staticmethod
    def _percentile_disc(c: Column, share: float) -> Column:
        """The smallest value whose share of rows reaches `share`."""
        values = F.array_sort(F.collect_list(c))
        return F.try_element_at(values, F.greatest(F.ceil(F.size(values) * F.lit(float(share))), F.lit(1)).cast("int"))

    def function(self, name: str, args: list[A.Expr], f: Frame) -> Column:
        ids = self.identity(args[0], f) if args else None
        if ids is not None:
            var = args[0].args[0]
            if name in ("TYPE", "LABEL"):
                return ids[0]
            if name == "LABELS":
                return F.array(ids[0])
            if name in ("ID", "ELEMENT_ID"):
                return ids[1]
            if name == "PROPERTIES":
                return F.struct(*[F.col(self.tick(f"{var}${p}")).alias(p) for p in f.scope[var].props])
            if name == "PROPERTY_EXISTS":
                p = args[1].args[0]
                return F.col(self.tick(f"{var}${p}")).isNotNull() if p in f.scope[var].props else F.lit(False)
            if name in ("ALL_DIFFERENT", "SAME"):
                all_ids = [self.identity(x, f) for x in args]
                return getattr(scalar, name.lower())(*[F.struct(x.alias("l"), y.alias("i")) for x, y in all_ids])
        if args and args[0].op in ("var", "path") and (args[0].op == "path" or f.scope.get(args[0].args[0], Var("value")).kind == "path"):
            p = self.col(args[0], f)
            if name in ("PATH_LENGTH", "LENGTH"):
                return F.size(p["edges"]).cast("long")
            if name == "NODES":
                return p["nodes"]
            if name in ("RELATIONSHIPS", "EDGES"):
                return p["edges"]
        if name == "VECTOR_DISTANCE":
            self.same_dimension(args[0], args[1])
            metric = args[2].args[0] if len(args) > 2 else "L2"
            try:
                return scalar.vector_distance(self.col(args[0], f), self.col(args[1], f), metric)
            except ValueError as x:
                raise BindFault(str(x)) from x
        return scalar.call(name, [self.col(x, f) for x in args])

    @staticmethod
    def same_dimension(a: A.Expr, b: A.Expr) -> None:
        sizes = [len(x.args) for x in (a, b) if x.op in ("vector", "list")]
        if len(sizes) == 2 and sizes[0] != sizes[1]:
            raise BindFault(f"vectors of {sizes[0]} and {sizes[1]} dimensions")


def outline(q: object, depth: int = 0) -> list[str]:
    """The logical plan as indented lines."""
    pad = "  " * depth
    if isinstance(q, A.Chain):
        return [f"{pad}Next", *[x for s, _ in q.steps for x in outline(s, depth + 1)]]
    if isinstance(q, A.SetOp):
        return [f"{pad}{q.op.title()}{' All' if q.all else ''}", *outline(q.left, depth + 1), *outline(q.right, depth + 1)]
    if not isinstance(q, A.Linear):
        return [f"{pad}{type(q).__name__}"]
    lines: list[str] = []
    for p in reversed(q.parts):
        here = lambda text: lines.append("  " * (depth + len(lines)) + text)
        if isinstance(p, A.Return):
            if p.order and p.order.limit is not None:
                here("Limit")
            if p.order and p.order.offset is not None:
                here("Offset")
            if p.order and p.order.keys:
                here("Sort")
            if p.distinct:
                here("Distinct")
            grouped = any(x.op == "agg" for e, _ in p.items for x in e.walk())
            here(("Aggregate: " if grouped else "Project: ") + ("*" if p.star else ", ".join(n for _, n in p.items)))
        elif isinstance(p, A.Match):
            if p.where is not None:
                here(f"Filter: {p.where.text}")
            for path in reversed(p.paths):
                for i in reversed(path.items):
                    if isinstance(i, A.Edge):
                        here(f"Expand: {i.var} {i.direction}" + (f" {i.low}..{i.high if i.high is not None else ''}" if i.low is not None else ""))
                    elif i is path.items[0] and isinstance(i, A.Node):
                        here(f"NodeScan: {i.var}")
        else:
            here(type(p).__name__)
    if not any("NodeScan" in x or "Call" in x for x in lines):
        lines.append("  " * (depth + len(lines)) + "OneRow")
    return lines


__all__ = ["BindFault", "Compiler", "Frame", "GraphFault", "Var", "outline"]
