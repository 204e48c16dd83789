"""Manifests, snapshots, LDBC folders, and the stream of degree changes."""

from __future__ import annotations

import json

import pytest

from graphloom.graph import GraphFault
from graphloom.session import Session
from graphloom.sources.fixtures import people_graph
from graphloom.sources.manifest import build_manifest, export_graph, import_graph, load_csv_topology, load_snapshot, save_snapshot
from graphloom.streaming.degrees import DegreeTable, maintain


def test_round_trip(spark, tmp_path):
    g = people_graph(spark, "g", 10)
    for kind in ("csv", "parquet"):
        folder = f"file://{tmp_path}/{kind}"
        export_graph(spark, g, folder, kind=kind)
        back = import_graph(spark, "h", f"{folder}/manifest.json")
        for label, v in g.vertices.items():
            assert sorted(map(tuple, v.df.collect())) == sorted(map(tuple, back.vertices[label].df.select(*v.df.columns).collect()))
        assert [e.df.count() for e in back.edges] == [25, 3, 2]
        assert dict(back.vertices["PERSON"].df.dtypes)["age"] == "tinyint"


def test_cells(spark, tmp_path):
    (tmp_path / "p.csv").write_text("vid,a,b\n1,,x\n2,5,\n")
    entry = {"label": "P", "file": {"path": "p.csv", "format": "csv"}, "properties": [{"name": "a", "logical_type": "Int32", "nullable": True}, {"name": "b", "logical_type": "String", "nullable": True}]}
    (tmp_path / "m.json").write_text(json.dumps({"vertices": [entry], "edges": []}))
    g = import_graph(spark, "g", f"file://{tmp_path}/m.json")
    assert sorted(map(tuple, g.vertices["P"].df.collect())) == [(1, None, "x"), (2, 5, None)]
    entry["properties"][1]["nullable"] = False
    (tmp_path / "m.json").write_text(json.dumps({"vertices": [entry], "edges": []}))
    with pytest.raises(Exception, match="not nullable"):
        import_graph(spark, "g", f"file://{tmp_path}/m.json").vertices["P"].df.collect()
    entry["properties"][0]["logical_type"] = {"Vector": 3}
    (tmp_path / "m.json").write_text(json.dumps({"vertices": [entry], "edges": []}))
    with pytest.raises(GraphFault):
        import_graph(spark, "g", f"file://{tmp_path}/m.json")


def test_snapshots(spark, tmp_path):
    s = Session(spark).use_graph(people_graph(spark, "g", 10))
    save_snapshot(spark, s.graph, f"file://{tmp_path}")
    s.gql("CALL mutate_graph('g', 'add_vertices', 'CITY', NULL, NULL, 5)")
    save_snapshot(spark, s.graph, f"file://{tmp_path}")
    back = load_snapshot(spark, f"file://{tmp_path}", "g")
    assert back.version == 1 and back.vertices["CITY"].df.count() == 7


def test_csv_folder(spark, tmp_path):
    (tmp_path / "person.csv").write_text("id|name|score\n1|a|1.5\n2|b|2\n")
    (tmp_path / "person_knows_person.csv").write_text("a|b|since\n1|2|2020\n2|1|2021\n")
    m = build_manifest(spark, f"file://{tmp_path}", f"file://{tmp_path}/m.json")
    assert m["vertices"][0]["properties"] == [{"name": "name", "logical_type": "String", "nullable": True}, {"name": "score", "logical_type": "Float64", "nullable": True}]
    assert m["edges"][0]["label"] == "knows" and m["edges"][0]["properties"][0]["logical_type"] == "Int64"
    s = Session(spark).use_graph(load_csv_topology(spark, f"file://{tmp_path}", "g"))
    assert s.gql("MATCH (a:person)-[:knows]->(b:person) RETURN a.name AS a, b.name AS b ORDER BY a").collect() == [("a", "b"), ("b", "a")]


def test_degree_stream(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table = DegreeTable(spark, f"{folder}/degrees")
    changes = "_src long, _dst long, delta int"
    for n, batch in enumerate([[(1, 2, 1), (1, 3, 1), (2, 3, 1)], [(1, 2, -1), (4, 1, 1), (2, 3, -1)]]):
        spark.createDataFrame(batch, changes).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = maintain(spark.readStream.schema(changes).parquet(f"{folder}/in"), table, f"{folder}/check")
        q.awaitTermination(60)
        table.merge(spark.createDataFrame([(1, 9)], "_vid long, delta int"), n)  # a replay is passed over
    assert sorted(map(tuple, table.read().collect())) == [(1, 1), (4, 1)]


def test_fixture_counts(spark):
    s = Session(spark)
    for name, n in (("a", 5), ("b", 10)):
        s.gql(f"CALL create_test_graph_data('{name}', {n})")
    counts = []
    for name in "ab":
        s.use_graph(name)
        counts.append([s.gql(f"MATCH {p} RETURN count(*) AS n").first()["n"] for p in ("(n:PERSON)", "(n:COMPANY)", "(p:PERSON)-[:WORKS_AT]->(c:COMPANY)", "(p:PERSON)-[:FRIEND]->(q:PERSON)")])
    assert counts == [[2, 1, 1, 4], [5, 2, 3, 25]]
    with pytest.raises(GraphFault):
        s.gql("CALL create_test_graph('a')")
