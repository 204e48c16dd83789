"""Estimators: formulas, and invariants against exact counts."""

from __future__ import annotations

import numpy as np
import pytest

from graphloom.estimate import bounds
from graphloom.estimate.catalog import Statistics, path_key, schema_walks
from graphloom.estimate.pcf import Pcf, across, minimum, multiply
from graphloom.estimate.tree import IGNORE, INNER, SCALE, Estimator
from graphloom.estimate.wander import wander_join
from graphloom.graph import GraphFault
from graphloom.operators.patterns import Pattern, exact_count
from graphloom.queries import _TREE
from graphloom.sources.tables import tables_graph


def test_pcf_basics():
    f = Pcf.make([4, 2, 1], [1, 3, 7])
    assert f.rows == 12 and f.support == 7 and f.self_join == 16 + 8 + 4
    assert f.at(0.5) == 4 and f.at(3) == 2 and f.at(8) == 0
    assert f.rows_at(2) == 6 and f.rank_of(6) == 2
    assert f.truncated(0.5).rows == pytest.approx(6)
    assert f.scaled(0.5).rows == 6 and f.capped(2).rows == 10 and f.cropped(1).rows == 4
    assert minimum([f, Pcf.make([3], [2])]).rows == 5
    assert multiply([f, Pcf.make([2], [7])]).rows == 24
    assert Pcf.make([], []).rows < 1e-10


def test_pcf_from_sequence_covers():
    d = np.sort(np.random.default_rng(1).zipf(1.8, 500))[::-1]
    f = Pcf.from_sequence(d)
    assert f.rows == pytest.approx(d.sum())
    assert f.self_join >= (d.astype(float) ** 2).sum()


def test_pcf_from_buckets_bounds():
    f = Pcf.from_buckets([(0, 5, 1), (2, 3, 4), (3, 1, 7)])
    assert f.value.tolist() == [8, 4, 1] and f.edge.tolist() == [1, 4, 9]
    assert Pcf.from_buckets([(3, 1, 7)], exact_top=True).value.tolist() == [7]


def test_across_keeps_rows():
    here, there = Pcf.make([4, 1], [2, 10]), Pcf.make([8, 2], [1, 5])
    g = across(Pcf.make([3], [10]), here, there)
    assert g.value.tolist() == [3] and g.support == pytest.approx(there.support)


def test_upper_bounds():
    assert bounds.upper_bound(0, 0) == 1
    assert bounds.upper_bound(0, 10) == pytest.approx(1 - 0.05**0.1)
    assert 0.5 < bounds.upper_bound(50, 100) < 0.6
    assert bounds.effective([1, 1, 1, 1]) == 4 and bounds.effective([]) == 0


def test_static_selectivity():
    s = {"total": 100, "nulls": 20, "low": "0", "high": "10", "ndv": 8}
    of = lambda op, **k: bounds.static_selectivity({"op": op, **k}, s)
    assert of("eq", value=3) == pytest.approx(0.1) and of("ne", value=3) == pytest.approx(0.7)
    assert of("lt", value=5) == pytest.approx(0.4) and of("gt", value={"Int64": 9}) == pytest.approx(0.08)
    assert of("in", values=[1, 2]) == pytest.approx(0.2) and of("is_null") == pytest.approx(0.2)
    assert bounds.static_selectivity({"op": "eq"}, None) == 0.01


def test_path_keys():
    assert path_key(["B", "X", "A"]) == path_key(["a", "x", "b"]) == ("a", "x", "b")


def test_tree_estimate_is_an_upper_bound(spark, data):
    g = tables_graph(spark, data)
    p = Pattern.parse(_TREE | {"predicates": []})
    truth = exact_count(g, p).first()["cardinality"]
    stats = Statistics(g)
    for hops in (1, 2, 3):
        assert Estimator(stats, hops).estimate(p) >= truth
    q = Pattern.parse(_TREE)
    for how in (INNER, SCALE, IGNORE):
        assert Estimator(stats, 2, how).estimate(q) > 0


def test_wander_join_is_near(spark, data):
    g = tables_graph(spark, data)
    p = Pattern.parse(_TREE)
    truth = exact_count(g, p).first()["cardinality"]
    assert wander_join(g, p, 1.0, 3) == pytest.approx(truth, rel=0.3)


def test_cycles(spark, data):
    g = tables_graph(spark, data)
    p = Pattern.parse({"vertices": [{"id": i, "label": x} for i, x in enumerate(["Orders", "Part", "Orders", "Supplier"])], "edges": [{"id": i, "label": x, "src": a, "dst": b} for i, (x, a, b) in enumerate([("CONTAINS", 0, 1), ("CONTAINS", 2, 1), ("SUPPLIED_BY", 0, 3), ("SUPPLIED_BY", 2, 3)])]})
    assert not p.is_tree()
    truth = exact_count(g, p).first()["cardinality"]
    assert Estimator(Statistics(g), 1).estimate(p) >= truth
    assert wander_join(g, p, 1.0, 1) == pytest.approx(truth, rel=0.5)


def test_patterns_are_checked():
    v = [{"id": 0, "label": "A"}]
    for bad in ({"vertices": v * 2, "edges": []}, {"vertices": v, "edges": [{"id": 0, "label": "x", "src": 0, "dst": 1}]}, {"vertices": v, "edges": [], "predicates": [{"target": "vertex", "id": 0, "property": "p", "op": "in"}]}):
        with pytest.raises(GraphFault):
            Pattern.parse(bad)


def test_schema_walks(spark, data):
    walks = schema_walks(tables_graph(spark, data), 1)
    assert ([("Customer", "PLACED", "out")], "Orders") in walks and ([("Region", "IN_REGION", "in")], "Nation") in walks


def test_predicates_and_decompositions(spark, data):
    import json

    from graphloom.queries import session

    s = session(spark, data)
    p = json.dumps(_TREE | {"predicates": [{"target": "edge", "id": 1, "property": "l_quantity", "op": "gt", "value": 40.0}, {"target": "vertex", "id": 0, "property": "c_mktsegment", "op": "in", "values": ["BUILDING", "MACHINERY"]}]})
    ask = lambda more: s.gql(f"CALL gcard_query('{p}', {more})").first()["cardinality"]
    free = s.gql(f"CALL gcard_query('{json.dumps(_TREE | {'predicates': []})}', 2, 100)").first()["cardinality"]
    assert 0 < ask("2, 0") < free and 0 < ask("2, 100") < free and ask("2, 100, 2") == free
    parts = json.dumps({"abstract_edges": [{"path_vertices": [0, 1, 2], "original_edge_ids": [0, 1]}, {"path_vertices": [0, 3], "original_edge_ids": [2]}]})
    assert ask(f"2, 100, 2, FALSE, 4, '{parts}'") >= exact_count(s.graph, Pattern.parse(_TREE | {"predicates": []})).first()["cardinality"]


def test_single_vertex(spark, data):
    g = tables_graph(spark, data)
    p = Pattern.parse({"vertices": [{"id": 0, "label": "customer"}], "edges": [], "predicates": [{"target": "vertex", "id": 0, "property": "c_acctbal", "op": "gt", "value": 0.0}]})
    truth = exact_count(g.changed(), Pattern({0: "Customer"}, [], p.predicates)).first()["cardinality"]
    assert Estimator(Statistics(g), sample=10_000).estimate(p) == truth
    assert Estimator(Statistics(g), sample=40).estimate(p) >= truth * 0.8
    assert Estimator(Statistics(g)).estimate(Pattern({0: "Customer"}, [])) == 150


def test_cheapest_spanning_trees():
    import itertools

    from graphloom.estimate.tree import spanning_trees

    ends = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3), (0, 1)]
    p = Pattern(dict.fromkeys(range(4), "a"), [(i, "x", a, b) for i, (a, b) in enumerate(ends)])
    cost = dict(zip(p.edges, [5.0, 1.0, 4.0, 2.0, 2.0, 7.0, 3.0], strict=True))
    every = [sum(cost[e] for e in t) for t in itertools.combinations(p.edges, 3) if Pattern(p.vertices, list(t)).is_tree()]
    found = spanning_trees(p, 1000, cost.__getitem__)
    assert [sum(cost[e] for e in t) for t in found] == sorted(every) and len({tuple(t) for t in found}) == len(every)
    assert spanning_trees(p, 3, cost.__getitem__) == found[:3]
    assert spanning_trees(Pattern(p.vertices, p.edges[:2]), 3) == []


def test_stars_and_functional_leaves(spark, data):
    g = tables_graph(spark, data)
    stats = Statistics(g)
    assert stats.functional("Customer", "IN_NATION", "out") and not stats.functional("Nation", "IN_NATION", "in")
    label = ["Orders", "Part", "Supplier", "Customer", "Nation"]
    edges = [("CONTAINS", 0, 1), ("SUPPLIED_BY", 0, 2), ("PLACED", 3, 0), ("IN_NATION", 3, 4)]
    p = Pattern.parse({"vertices": [{"id": i, "label": x} for i, x in enumerate(label)], "edges": [{"id": i, "label": x, "src": a, "dst": b} for i, (x, a, b) in enumerate(edges)]})
    truth = exact_count(g, p).first()["cardinality"]
    ranked = Estimator(stats, 2, star_degree=1, functional=False).estimate(p)
    starred = Estimator(stats, 2, functional=False).estimate(p)
    assert truth <= starred <= ranked
    assert truth <= Estimator(stats, 2).estimate(p) <= starred
    parts = [((e[2], e[3]), [e]) for e in p.edges]
    assert [x[1][0][0] for x in Estimator(stats).stripped(p, parts)] == [0, 1]  # the nation, then the customer of an order
    q = Pattern(p.vertices, p.edges, [{"target": "vertex", "id": 4, "property": "n_name", "op": "eq", "value": "FRANCE"}])
    assert len(Estimator(stats).stripped(q, parts)) == 4
    two = stats.star(((("Orders", "CONTAINS", "out"),),) * 2)
    assert two.rows >= (two.value > 1).any() and stats.star(((("Orders", "CONTAINS", "out"),), (("Orders", "SUPPLIED_BY", "out"),))).support <= g.vertices["Orders"].df.count()
