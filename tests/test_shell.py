"""The shell, script splitting, output modes, and databases in folders."""

from __future__ import annotations

from graphloom.cli import MODES, Shell, shown, statements
from graphloom.database import Database
from graphloom.session import Session
from graphloom.sources.fixtures import people_graph


def test_splitting():
    assert list(statements("RETURN 'a;b'; -- no; comment\n RETURN 2 ; :mode csv; RETURN `x;y`")) == ["RETURN 'a;b'", "RETURN 2", ":mode csv", "RETURN `x;y`"]


def test_modes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string").coalesce(1)
    got = {m: shown(df, m) for m in MODES}
    assert got["csv"] == "x,y\n1,a\n2,"
    assert got["json"].splitlines() == ['{"x": 1, "y": "a"}', '{"x": 2, "y": null}']
    assert got["markdown"].splitlines()[:2] == ["| x | y    |", "|---|------|"]
    assert got["psql"].splitlines()[1] == "---+------"
    assert got["sharp"].splitlines()[0] == "┌───┬──────┐" and got["modern"].splitlines()[-1] == "╰───┴──────╯"


def test_shell(spark):
    out = []
    s = Shell(Session(spark), out.append)
    s.script("CALL create_test_graph_data('g', 4); SESSION SET GRAPH g; :mode csv; MATCH (n:PERSON) RETURN count(*) AS n; RETURN nope; :time RETURN 1 AS x")
    assert out[:4] == ["OK", "OK", "n\n2", "Error: variable nope isn't bound"] and out[4] == "x\n1" and out[5].endswith("ms")
    assert s.command(":help") and s.command(":history") and not s.command(":quit")


def test_database_reopens(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    db = Database(spark, folder)
    db.catalog.register("default", people_graph(spark, "g", 10))
    db.save("g")
    s = db.session().use_graph("g")
    s.gql("CALL mutate_graph('g', 'delete_vertices', 'PERSON', NULL, NULL, 2)")
    again = Database(spark, folder).session().use_graph("g")
    assert again.gql("MATCH (n:PERSON) RETURN count(*) AS n").first()["n"] == 5  # the change wasn't saved
    db.save("g")
    again = Database(spark, folder).session().use_graph("g")
    assert again.gql("MATCH (n:PERSON)-[:FRIEND]->(m:PERSON) RETURN count(*) AS n").first()["n"] == 9
    assert db.vacuum() == 1
    db.drop("g")
    assert Database(spark, folder).catalog.graphs("default") == {}
