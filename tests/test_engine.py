"""Semantics that the tables don't show: nulls, errors, sessions, transactions, plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.graph import DST, EID, SRC, VID, EdgeSet, Graph, GraphFault, VertexSet
from graphloom.operators import relational
from graphloom.plans.compile import BindFault
from graphloom.session import Session


@pytest.fixture
def tiny(spark):
    """a -> b -> c -> a, a -> a, and d alone; d has no age."""
    v = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", None), (3, "d", 4)], f"{VID} long, name string, age int")
    e = spark.createDataFrame([(0, 0, 1, 5), (1, 1, 2, 6), (2, 2, 0, 7), (3, 0, 0, 8)], f"{EID} long, {SRC} long, {DST} long, w int")
    return Session(spark).use_graph(Graph("t", {"P": VertexSet("P", v)}, (EdgeSet("K", "P", "P", e),)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cycle_needs_equality(tiny):
    assert rows(tiny.gql("MATCH (x)-[:K]->(y)-[:K]->(z)-[:K]->(x) WHERE x <> y RETURN x.name AS n")) == [("a",), ("a",), ("b",), ("b",), ("c",), ("c",)][:0] + rows(tiny.gql("MATCH (x)-[:K]->(y)-[:K]->(z)-[:K]->(q) WHERE x = q AND x <> y RETURN x.name AS n"))


def test_loop_counts_once_undirected(tiny):
    assert tiny.gql("MATCH (x)-[:K]-(y) RETURN count(*) AS n").first()["n"] == 7


def test_unbounded_ends_on_cycles(tiny):
    assert tiny.gql("MATCH (x:P {name: 'a'})-[:K]->+(y) RETURN count(DISTINCT y) AS n").first()["n"] == 3


def test_trail_and_acyclic(tiny):
    assert tiny.gql("MATCH ACYCLIC (x {name: 'a'})-[:K]->{1,5}(y) RETURN count(*) AS n").first()["n"] == 2
    trails = tiny.gql("MATCH TRAIL (x {name: 'a'})-[:K]->{1,5}(y) RETURN count(*) AS n").first()["n"]
    assert trails == 8  # loop first, then round, or round and then the loop, at each length
    assert tiny.gql("MATCH (x {name: 'a'})-[:K]->{1,5}(y) RETURN count(*) AS n").first()["n"] > trails


def test_shortest(tiny):
    got = rows(tiny.gql("MATCH p = ANY SHORTEST (x {name: 'b'})-[:K]->*(y) RETURN y.name AS n, path_length(p) AS k"))
    assert got == [("a", 2), ("b", 0), ("c", 1)]


def test_nulls_sort_last(tiny):
    assert [r["age"] for r in tiny.gql("MATCH (x:P) RETURN x.age AS age ORDER BY age").collect()] == [1, 2, 4, None]
    assert [r["age"] for r in tiny.gql("MATCH (x:P) RETURN x.age AS age ORDER BY age DESC").collect()] == [4, 2, 1, None]


def test_distinct_sum_isnt_null(tiny):
    assert tiny.gql("RETURN 1 AS x UNION ALL RETURN 1 AS x NEXT RETURN sum(DISTINCT x) AS s, avg(DISTINCT x) AS a").first() == (1, 1.0)


def test_limit_after_filter(tiny):
    assert tiny.gql("MATCH (x:P) WHERE x.age > 1 RETURN x.name AS n LIMIT 2").count() == 2


def test_unknown_names(tiny):
    for text in ("MATCH (x:Nope) RETURN x", "MATCH (x:P) RETURN x.nope AS n", "RETURN y", "MATCH (x:P)-[:Nope]->(y) RETURN x", "RETURN 1 + 'a'", "CALL nope()", "RETURN vector_distance(VECTOR[1], VECTOR[1, 2])"):
        with pytest.raises((BindFault, GraphFault)):
            tiny.gql(text)


def test_division_by_zero(tiny):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tiny.gql("RETURN 1 / 0 AS x").collect()


def test_label_id_is_real(tiny):
    assert tiny.gql("MATCH (x:P {name: 'a'}) RETURN x").first()["x"]["_label"] == 1


def test_null_keys_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "j int, b string")
    assert rows(relational.hash_join(a, b, [("k", "j")]).select("a", "b")) == [("x", "p"), ("y", "q")]
    assert relational.hash_join(a, b, []).count() == 4


def test_session_commands(tiny):
    tiny.gql("SESSION SET VALUE $n = 2")
    assert tiny.gql("MATCH (x:P) RETURN x.name AS n ORDER BY n LIMIT $n").count() == 2
    tiny.gql("CREATE GRAPH other AS COPY OF t; SESSION SET GRAPH other")
    assert tiny.gql("MATCH (x:P) RETURN count(*) AS n").first()["n"] == 4
    with pytest.raises(GraphFault):
        tiny.gql("CREATE GRAPH other")
    tiny.gql("CREATE GRAPH IF NOT EXISTS other; DROP GRAPH other")
    with pytest.raises(GraphFault):
        tiny.gql("SESSION SET GRAPH other")
    tiny.gql("SESSION CLOSE")
    with pytest.raises(GraphFault):
        tiny.gql("RETURN 1")


def test_transactions(tiny):
    tiny.gql("START TRANSACTION; CALL mutate_graph('t', 'delete_vertices', 'P', NULL, NULL, 1)")
    assert tiny.gql("MATCH (x:P) RETURN count(*) AS n").first()["n"] == 3
    assert tiny.gql("MATCH (x:P)-[:K]->(y) RETURN count(*) AS n").first()["n"] == 1
    tiny.gql("ROLLBACK")
    assert tiny.gql("MATCH (x:P) RETURN count(*) AS n").first()["n"] == 4


def test_conflicting_versions(tiny):
    g = tiny.graph
    tiny.catalog.commit("default", g, g.changed())
    with pytest.raises(GraphFault):
        tiny.catalog.commit("default", g, g.changed())


def test_explain(tiny):
    lines = [r["plan"] for r in tiny.gql("EXPLAIN MATCH (x:P)-[e:K]->(y) WHERE x.age > 1 RETURN y.name AS n LIMIT 1").collect()]
    assert lines[:6] == ["Explain:", "  Limit", "    Project: n", "      Filter: x . age > 1", "        Expand: e out", "          NodeScan: x"]


def test_pushdown_and_pruning(spark, data):
    from graphloom.queries import session

    df = session(spark, data).gql("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 RETURN c.c_name AS n")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_totalprice,400000.0)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_unasked_vertices_arent_joined(spark, data):
    from graphloom.queries import session

    df = session(spark, data).gql("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) RETURN o.o_orderstatus AS s, count(*) AS n")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # orders, which hold the edge to their customer, with lines; neither customers nor parts


def test_factorised_count_aggregates_first(spark, data):
    from graphloom.queries import session

    plan = session(spark, data).gql("MATCH (p:Part)<-[:CONTAINS]-(o:Orders)-[:SUPPLIED_BY]->(s:Supplier) RETURN count(*) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")  # a sum below the join


def test_factorised_operators(spark):
    a = relational.factorize(spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, v int"), ["k"], "n")
    assert relational.factorized_aggregate(a, ["n"], "COUNT").first()["count"] == 3
    assert relational.factorized_aggregate(a, ["n"], "COUNT", lambda x: x["v"], "n").first()["count"] == 2
    assert relational.factorized_aggregate(a, ["n"], "SUM", lambda x: x["v"], "n").first()["sum"] == 5
    assert relational.factorized_aggregate(a, ["n"], "AVG", lambda x: x["v"], "n").first()["avg"] == 2.5
    assert relational.factorized_aggregate(a.where("k = 9"), ["n"], "SUM", lambda x: x["v"], "n").first()["sum"] is None
    assert relational.flatten(a, "n").where(F.col("v").isNotNull()).count() == 2


def test_like_takes_backslashes_literally(spark):
    s = Session(spark)
    assert s.gql(r"RETURN 'a\\b' LIKE 'a\\_' AS x").first()["x"] is True


def test_kleene(spark):
    s = Session(spark)
    assert s.gql("RETURN (UNKNOWN AND FALSE) AS a, (UNKNOWN OR TRUE) AS b, (UNKNOWN AND TRUE) IS UNKNOWN AS c").first() == (False, True, True)


def brute_shortest(vertices, edges, label, low, high):
    """Counts of (a, b, length) of all shortest walks along undirected edges between vertices of a label."""
    nexts = {v: [] for v in vertices}
    for a, b in edges:
        nexts[a].append(b)
        if a != b:
            nexts[b].append(a)
    out = {}
    for a in (v for v in vertices if vertices[v] == label):
        at, done = {a: 1}, set()
        for depth in range(high + 1):
            if depth >= low:
                out |= {(a, b, depth): n for b, n in at.items() if b not in done and vertices[b] == label}
                done |= set(at)
            further = {}
            for v, n in at.items():
                for w in nexts[v]:
                    further[w] = further.get(w, 0) + n
            at = further
    return out


def labelled(spark, vertices, edges):
    labels = sorted(set(vertices.values()))
    sets = {x: VertexSet(x, spark.createDataFrame([(v, v * 10) for v in vertices if vertices[v] == x], f"{VID} long, k long")) for x in labels}
    kinds = {}
    for i, (a, b) in enumerate(edges):
        kinds.setdefault((vertices[a], vertices[b]), []).append((i, a, b))
    return Session(spark).use_graph(Graph("g", sets, tuple(EdgeSet("K", a, b, spark.createDataFrame(rows, f"{EID} long, {SRC} long, {DST} long")) for (a, b), rows in kinds.items())))


def test_shortest_from_leaves_shares_a_search(spark, monkeypatch):
    from graphloom.plans import compile as c

    leaves, others = range(1, 121), range(1000, 2200)
    vertices = {0: "H", **dict.fromkeys(leaves, "P"), **dict.fromkeys(others, "Q")}
    s = labelled(spark, vertices, [(v, 0) for v in (*leaves, *others)])
    rows_written, plain = [], c.written

    def counted(df, name):
        out = plain(df, name)
        rows_written.append(out.count())
        return out

    monkeypatch.setattr(c, "written", counted)
    monkeypatch.setattr(c, "PAIRS", 500, raising=False)  # the leaves are dealt into blocks
    got = s.gql("MATCH p = ALL SHORTEST (a:P)-[:K]-{1,4}(b:P) RETURN a.k AS a, b.k AS b, path_length(p) AS n, relationships(p)[1].id AS e").collect()
    assert sorted((r["a"], r["b"], r["n"], r["e"]) for r in got) == sorted((a * 10, b * 10, 2, b - 1) for a in leaves for b in leaves)
    assert sum(rows_written) < 3 * len(vertices)  # not a row for each leaf and vertex


@pytest.mark.parametrize("low", [0, 1, 2])
def test_shortest_matches_brute_force(spark, low):
    """Leaves, double edges, loops, vertices alone and rings; some starts share a search, others don't."""
    import random
    from collections import Counter

    r = random.Random(low)
    vertices = {v: "PQ"[v % 2] for v in range(38)}
    inner = [(r.randrange(6), r.randrange(6)) for _ in range(7)]
    edges = inner + [(v, r.randrange(3)) for v in range(6, 34)] + [(34, 34), (35, 36), (36, 35), (9, 9), (8, 3), (0, 4), (2, 4)]
    edges += [edges[7], edges[11], edges[12]]
    s = labelled(spark, vertices, edges)
    want = brute_shortest(vertices, edges, "P", low, 4)
    got = Counter((x["a"], x["b"], x["n"]) for x in s.gql(f"MATCH p = ALL SHORTEST (a:P)-[:K]-{{{low},4}}(b:P) RETURN id(a) AS a, id(b) AS b, path_length(p) AS n").collect())
    assert got == want
    one = s.gql(f"MATCH p = ANY SHORTEST (a:P)-[:K]-{{{low},4}}(b:P) RETURN a.k AS a, b.k AS b, path_length(p) AS n").collect()
    assert sorted((x["a"] // 10, x["b"] // 10, x["n"]) for x in one) == sorted(want)
    round_trips = Counter((x["a"], x["n"]) for x in s.gql(f"MATCH p = ALL SHORTEST (a:P)-[:K]-{{{low},4}}(a) RETURN id(a) AS a, path_length(p) AS n").collect())
    assert round_trips == Counter({(a, n): k for (a, b, n), k in want.items() if a == b})
