"""The grammar: texts that parse to a given shape, and texts that don't parse."""

from __future__ import annotations

import pytest

from graphloom.plans import ast as A
from graphloom.plans.lexer import SyntaxFault, tokenize
from graphloom.plans.parser import parse

GOOD = [
    "MATCH (p:Person {id: 4})-[e:livesIn]->(city) RETURN p.name AS n, city.id AS c",
    "MATCH (n:Account{id:12}) RETURN n NEXT OPTIONAL MATCH (n)-[e:transfer]->(m:Account) WHERE e.ts > 45 AND e.ts < 50 RETURN n, sum(e.amount) AS s, count(e) AS k",
    "MATCH (a:Person WHERE a.id = 1)<-[e1]-(m)-[:replyOf]->{1,}(post:Post) WHERE type(e1) = 'x' RETURN m.id AS id ORDER BY id DESC, post.id LIMIT 10",
    "MATCH TRAIL p = (a)-[:X]->*(b) RETURN p",
    "MATCH p = ALL SHORTEST (a)-[:X|Y]-+(b) RETURN path_length(p)",
    "MATCH SHORTEST 3 PATH GROUPS (a)~[:X]~(b) RETURN a",
    "MATCH (a)<-[e]->(b), (b)<~[f]~(c), (c)~[g]~>(d), (d)-(e1) RETURN *",
    "MATCH DIFFERENT EDGES (a)-[]->(b) KEEP ANY SHORTEST WHERE a.x = 1 RETURN a",
    "MATCH ((a)-[:X]->(b) WHERE a.v < b.v){2,4} RETURN count(*)",
    "MATCH (n:A&!B|%) RETURN n",
    "RETURN 1 + 2 * 3 UNION ALL RETURN 4 EXCEPT RETURN 5 OTHERWISE RETURN 6",
    "CALL f('x', 1) YIELD a, b AS c RETURN a ORDER BY c OFFSET 2 LIMIT $n",
    "USE g MATCH (n) RETURN n",
    "SESSION SET GRAPH g; SESSION RESET GRAPH; SESSION CLOSE",
    "CREATE VECTOR INDEX i IF NOT EXISTS FOR (n:P) ON (n.v); DROP VECTOR INDEX IF EXISTS i",
    "EXPLAIN MATCH (n) RETURN n",
    "START TRANSACTION READ ONLY; COMMIT; ROLLBACK",
    "RETURN CASE WHEN 1 < 2 THEN 'a' ELSE 'b' END, NULL IS NULL, TRUE IS NOT FALSE, VECTOR[1, -2.5], DATE '2020-01-01', DURATION 'P1D', {a: 1}, [1, 2][0]",
    "FOR x IN [1, 2] WITH OFFSET i LET y = x FILTER WHERE y > 1 RETURN x, i",
    "MATCH (a) WHERE EXISTS {(a)-[:X]->(b) WHERE b.z = 1} AND NOT EXISTS {MATCH (a)<-[]-()} RETURN a -- comment\n",
    "/* block */ MATCH (n) // line\n RETURN percentile_cont(n.x, 0.5), collect_list(DISTINCT n.y) GROUP BY n.z HAVING count(*) > 1",
]
BAD = ["MATCH", "MATCH (a RETURN a", "RETURN", "MATCH (a)-[>(b) RETURN a", "RETURN 1 +", "RETURN 'open", "FOO BAR", "MATCH (a){ RETURN a", "CALL f(", "RETURN CASE WHEN 1 THEN 2"]


@pytest.mark.parametrize("text", GOOD)
def test_parses(text):
    assert parse(text)


@pytest.mark.parametrize("text", BAD)
def test_refuses(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def test_precedence():
    (q,) = parse("RETURN 1 + 2 * 3 = 7 AND NOT FALSE OR TRUE")
    e = q.parts[0].items[0][0]
    assert e.op == "or" and e.args[0].op == "and" and e.args[0].args[0].op == "=" and e.args[0].args[0].args[0].op == "+"
    (q,) = parse("RETURN 10 - 4 - 3")
    e = q.parts[0].items[0][0]
    assert e.args[0].op == "-"  # to the left


def test_edges():
    (q,) = parse("MATCH (a)-[:X]->(b)<-[y]-(c)-(d)->(e)<-(f)~[z]~(g) RETURN *")
    assert [i.direction for i in q.parts[0].paths[0].items[1::2]] == ["out", "in", "any", "out", "in", "any"]


def test_quantifiers():
    (q,) = parse("MATCH (a)-[:X]->*(b)-[:X]->+(c)-[:X]->{2}(d)-[:X]->{1,3}(e)-[:X]->{,4}(f)-[:X]->?(g) RETURN *")
    assert [(e.low, e.high) for e in q.parts[0].paths[0].items[1::2]] == [(0, None), (1, None), (2, 2), (1, 3), (0, 4), (0, 1)]


def test_set_operations_lean_left():
    (q,) = parse("RETURN 1 UNION RETURN 2 INTERSECT ALL RETURN 3")
    assert isinstance(q, A.SetOp) and q.op == "INTERSECT" and q.all and q.left.op == "UNION" and not q.left.all


def test_strings_and_names():
    assert [t.text for t in tokenize("'it''s' \"a\\nb\" `odd``name` 'caf\\u00e9'")][:4] == ["it's", "a\nb", "odd`name", "café"]
    assert [t.text for t in tokenize("0x1F 1_000 1.5e3 .5")][:4] == ["0x1F", "1_000", "1.5e3", ".5"]
