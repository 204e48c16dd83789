"""The registered queries of the engine: text or DataFrame operators over the tables graph, each with equivalent SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import VID, Graph
from .operators import mutate, patterns, relational, vector
from .scratch import shared_dir
from .session import Session
from .sources.files import read_text
from .sources.manifest import export_graph, import_graph, load_snapshot
from .sources.tables import table, tables_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark).use_graph(tables_graph(spark, sf_dir))


def text(name: str, gql: str, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).gql(gql)
    if sql:
        ORACLE[name] = sql


def operator(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- scans, filters, projection
text("flagship", "MATCH (c:Customer)-[p:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 RETURN c.c_name AS name, o.o_orderkey AS k ORDER BY k LIMIT 10", "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 ORDER BY k LIMIT 10")
text("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation")
text("scan_multi_label", "MATCH (n:Region|Nation) RETURN label(n) AS l, id(n) AS id, n.r_name AS r, n.n_name AS n", "SELECT 'Region' AS l, r_regionkey::BIGINT AS id, r_name AS r, NULL AS n FROM region UNION ALL SELECT 'Nation', n_nationkey, NULL, n_name FROM nation")
text("return_star", "MATCH (n:Nation) LET k = n.n_nationkey, name = n.n_name RETURN k, name NEXT RETURN *", "SELECT n_nationkey AS k, n_name AS name FROM nation")
text("one_row", "RETURN 1 AS x, 'a' AS y, TRUE AS z", "SELECT 1 AS x, 'a' AS y, TRUE AS z")
text("filter_cmp", "MATCH (o:Orders) WHERE o.o_totalprice >= 200000 AND o.o_orderstatus <> 'F' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F'")
text("filter_kleene", "MATCH (e:Event) WHERE (e.value > 50 OR e.event_type = 'click') AND NOT (e.value < 10) RETURN e.event_id AS k", "SELECT event_id AS k FROM events WHERE (value > 50 OR event_type = 'click') AND NOT (value < 10)")
text("filter_is_null", "MATCH (e:Event) RETURN e.event_id AS k, e.value IS NULL AS a, e.value IS NOT NULL AS b", "SELECT event_id AS k, value IS NULL AS a, value IS NOT NULL AS b FROM events")
text("filter_in_like", "MATCH (p:Part) WHERE p.p_size IN [1, 5, 9] AND p.p_brand LIKE 'Brand%1' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9) AND p_brand LIKE 'Brand%1'")
text("prop_projection", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal * 2 AS b", "SELECT c_custkey AS k, c_acctbal * 2 AS b FROM customer")
text("edge_property", "MATCH (o:Orders)-[e:CONTAINS]->(p:Part) WHERE e.l_quantity > 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, e.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
text("element_predicates", "MATCH (c:Customer {c_mktsegment: 'BUILDING'} WHERE c.c_acctbal > 0)-[:PLACED]->(o:Orders WHERE o.o_orderstatus = 'O') RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND o_orderstatus = 'O'")
text("return_distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s", "SELECT DISTINCT c_mktsegment AS s FROM customer")
text("return_vertex", "MATCH (n:Region) RETURN n NEXT RETURN n.r_regionkey AS k, id(n) AS id", "SELECT r_regionkey AS k, r_regionkey::BIGINT AS id FROM region")
text("match_yield", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) YIELD r RETURN id(r) AS k", "SELECT r_regionkey::BIGINT AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
text("finish", "MATCH (n:Region) FINISH", "SELECT TRUE AS finished FROM region WHERE FALSE")
text("next_chain", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n, count(*) AS k NEXT MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, sum(k) AS s", "SELECT r_name AS r, count(*) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
text("let_for_filter", "FOR x IN [1, 2, 3, 4] LET y = x * 10 FILTER y > 15 RETURN x, y", "SELECT x, x * 10 AS y FROM (VALUES (1), (2), (3), (4)) t(x) WHERE x * 10 > 15")
text("for_ordinality", "FOR x IN ['a', 'b'] WITH ORDINALITY i RETURN x, i", "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 2)) t(x, i)")
text("select_statement", "SELECT n.n_name AS x FROM MATCH (n:Nation) WHERE n.n_nationkey < 3", "SELECT n_name AS x FROM nation WHERE n_nationkey < 3")
text("nested_query", "{ MATCH (n:Nation) RETURN n.n_regionkey AS r, n.n_nationkey AS k } FILTER k > 5 RETURN r, count(*) AS c", "SELECT n_regionkey AS r, count(*) AS c FROM nation WHERE n_nationkey > 5 GROUP BY 1")
text("explain", "EXPLAIN RETURN 1", "SELECT unnest(['Explain:', '  Project: 1', '    OneRow']) AS plan")

# -- patterns
text("path1", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
text("path2", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
text("path3", "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[e:SUPPLIED_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation) WHERE e.l_discount > 0.05 RETURN n.n_name AS n, c.c_mktsegment AS m, count(*) AS k", "SELECT n_name AS n, c_mktsegment AS m, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_discount > 0.05 GROUP BY 1, 2")
text("path_incoming", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN r.r_name AS r, s.s_suppkey AS s", "SELECT r_name AS r, s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
text("path_undirected", "MATCH (a:Nation)-[:IN_REGION]-(b) RETURN id(a) AS a, id(b) AS b", "SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation")
text("path_unlabelled_edge", "MATCH (a:Nation)-[e]->(b:Region) RETURN id(a) AS a, type(e) AS t, id(b) AS b", "SELECT n_nationkey::BIGINT AS a, 'IN_REGION' AS t, n_regionkey::BIGINT AS b FROM nation")
text("path_cycle", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(a) RETURN id(a) AS a, id(r) AS r", "SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS r FROM nation")
text("multi_path", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, s.s_suppkey AS s, o.o_orderkey AS o", "SELECT c_custkey AS c, s_suppkey AS s, o_orderkey AS o FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
text("multi_match", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(c) AS k", "SELECT r_name AS r, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
text("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 RETURN c.c_custkey AS c, coalesce(o.o_orderkey, -1) AS o", "SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
text("optional_aggregate", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 RETURN c.c_custkey AS c, count(o) AS n, sum(o.o_totalprice) AS s", "SELECT c_custkey AS c, count(o_orderkey) AS n, sum(o_totalprice) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY 1")
text("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
text("not_exists_anti", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
text("exists_in_or", "MATCH (c:Customer) WHERE c.c_custkey < 9 OR EXISTS { (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey < 9 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
text("exists_outer_value", "FOR x IN [0, 3, 100] MATCH (r:Region) WHERE EXISTS { (r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey < x } RETURN x, r.r_name AS r", "SELECT x, r_name AS r FROM (VALUES (0), (3), (100)) t(x), region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < x)")
text("not_exists_outer_value", "FOR x IN [0, 3] MATCH (r:Region) WHERE NOT EXISTS { (r)<-[:IN_REGION]-(n:Nation {n_nationkey: x}) } RETURN x, r.r_name AS r", "SELECT x, r_name AS r FROM (VALUES (0), (3)) t(x), region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey = x)")
text("exists_nested", "MATCH (n:Nation) WHERE EXISTS { (n)<-[:IN_NATION]-(c:Customer) WHERE c.c_acctbal > 9900 AND EXISTS { (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * n.n_nationkey } } RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * n_nationkey))")
text("exists_result", "MATCH (n:Nation) RETURN n.n_name AS n, EXISTS { (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > n.n_nationkey * 400 } AS e", "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 400) AS e FROM nation")
text("label_and_or_not", "MATCH (n:(Region|Nation|Supplier)&!Supplier) RETURN label(n) AS l, count(*) AS k", "SELECT 'Region' AS l, count(*) AS k FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")
text("quantified_1_3", "MATCH (a:Region {r_name: 'ASIA'})-[:IN_REGION]-{1,3}(b) RETURN label(b) AS l, id(b) AS b, count(*) AS k", """
    WITH e AS (SELECT 'Nation' || n_nationkey AS a, 'Region' || n_regionkey AS b FROM nation), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    s AS (SELECT 'Region' || r_regionkey AS v FROM region WHERE r_name = 'ASIA'), l1 AS (SELECT u.b AS v FROM s JOIN u ON u.a = s.v),
    l2 AS (SELECT u.b AS v FROM l1 JOIN u ON u.a = l1.v), l3 AS (SELECT u.b AS v FROM l2 JOIN u ON u.a = l2.v), x AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT v[1:6] AS l, v[7:]::BIGINT AS b, count(*) AS k FROM x GROUP BY v""")  # fmt: skip
text("quantified_edge_list", "MATCH (c:Customer)-[e]->{2,2}(r:Region) RETURN c.c_custkey AS c, size(e) AS n, id(r) AS r", "SELECT c_custkey AS c, 2 AS n, n_regionkey::BIGINT AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
text("quantified_optional", "MATCH (n:Nation)-[:IN_REGION]->?(x) RETURN label(x) AS l, id(x) AS x", "SELECT 'Nation' AS l, n_nationkey::BIGINT AS x FROM nation UNION ALL SELECT 'Region', n_regionkey FROM nation")
text("quantified_unbounded", "MATCH (s:Supplier)-[:IN_NATION|IN_REGION]->+(x) RETURN s.s_suppkey AS s, label(x) AS l, id(x) AS x", "SELECT s_suppkey AS s, 'Nation' AS l, s_nationkey::BIGINT AS x FROM supplier UNION ALL SELECT s_suppkey, 'Region', n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
text("quantified_group", "MATCH (s:Supplier) ((a)-[:IN_NATION|IN_REGION]->(b)){2} (r:Region) RETURN s.s_suppkey AS s, r.r_name AS r", "SELECT s_suppkey AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
text("path_trail", "MATCH TRAIL (a:Nation)-[:IN_REGION]-{2,2}(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
text("path_walk", "MATCH WALK (a:Region {r_name: 'ASIA'})-[:IN_REGION]-{2,2}(b:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
text("path_acyclic", "MATCH ACYCLIC (a:Nation)-[:IN_REGION]-{2,2}(b:Nation) RETURN id(a) AS a, id(b) AS b", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
text("path_simple", "MATCH SIMPLE (a:Nation)-[:IN_REGION]-{2,2}(b:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
text("path_union", "MATCH (a:Nation)-[:IN_REGION]->(x) | (a:Supplier)-[:IN_NATION]->(x) RETURN label(a) AS l, id(a) AS a, id(x) AS x", "SELECT 'Nation' AS l, n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS x FROM nation UNION ALL SELECT 'Supplier', s_suppkey, s_nationkey FROM supplier")
text("path_multiset", "MATCH (a:Nation) |+| (a:Nation) RETURN id(a) AS a", "SELECT n_nationkey::BIGINT AS a FROM nation UNION ALL SELECT n_nationkey FROM nation")
text("path_variable", "MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN c.c_custkey AS c, path_length(p) AS n, nodes(p)[2].id AS r", "SELECT c_custkey AS c, 2::BIGINT AS n, n_regionkey::BIGINT AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
text("different_edges", "MATCH DIFFERENT EDGES (a:Nation)-[x:IN_REGION]->(r)<-[y:IN_REGION]-(b:Nation) RETURN id(a) AS a, id(b) AS b", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
text("different_edges_quantified", "MATCH DIFFERENT EDGES (a:Nation)-[:IN_REGION]-{2,2}(b:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
text("different_edges_paths", "MATCH DIFFERENT EDGES (a:Nation)-[:IN_REGION]-{1,2}(b), (a)<-[x:IN_NATION]-(s:Supplier)-[y:IN_NATION]->(a) RETURN count(*) AS n", "SELECT 0::BIGINT * count(*) AS n FROM supplier")
text("shortest_any", "MATCH p = ANY SHORTEST (a:Region {r_name: 'ASIA'})-[:IN_REGION]-*(b) RETURN label(b) AS l, id(b) AS b, path_length(p) AS n", "SELECT 'Region' AS l, r_regionkey::BIGINT AS b, 0::BIGINT AS n FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'Nation', n_nationkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
text("shortest_all", "MATCH p = ALL SHORTEST (a:Supplier)-[:IN_NATION]-{1,4}(b:Supplier) RETURN a.s_suppkey AS a, b.s_suppkey AS b, path_length(p) AS n", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, 2::BIGINT AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
text("shortest_k", "MATCH p = SHORTEST 2 (a:Region)-[:IN_REGION]-{2,2}(b:Region) RETURN id(a) AS a, count(*) AS n", "SELECT n_regionkey::BIGINT AS a, least(count(*), 2)::BIGINT AS n FROM nation GROUP BY 1")
text("shortest_group", "MATCH p = SHORTEST 1 GROUP (a:Nation)-[:IN_REGION]-{1,2}(b:Nation) RETURN id(a) AS a, id(b) AS b", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
text("use_graph", "USE CURRENT_GRAPH MATCH (n:Region) RETURN n.r_name AS r", "SELECT r_name AS r FROM region")
text("node_equality", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
text("source_destination", "MATCH (a:Nation)-[e:IN_REGION]-(b) RETURN a IS SOURCE OF e AS s, b IS DESTINATION OF e AS d, a IS LABELED :Nation AS l, count(*) AS n", "SELECT TRUE AS s, TRUE AS d, TRUE AS l, count(*) AS n FROM nation")

# -- aggregation
text("agg_global", "MATCH (o:Orders) RETURN count(*) AS n, sum(o.o_orderkey) AS s, avg(o.o_orderkey) AS a, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s, avg(o_orderkey) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
text("agg_empty", "MATCH (o:Orders) WHERE o.o_orderkey < 0 RETURN count(*) AS n, sum(o.o_orderkey) AS s, avg(o.o_totalprice) AS a", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
text("agg_group", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(*) AS n, max(o.o_totalprice) AS m", "SELECT o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1")
text("agg_multi_key", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment AS a, o.o_orderpriority AS b, count(*) AS n GROUP BY a, b", "SELECT c_mktsegment AS a, o_orderpriority AS b, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
text("agg_group_hidden", "MATCH (c:Customer) RETURN count(*) AS n GROUP BY c.c_mktsegment", "SELECT count(*) AS n FROM customer GROUP BY c_mktsegment")
text("agg_having", "MATCH (c:Customer) RETURN c.c_nationkey AS k, count(*) AS n HAVING count(*) > 55", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 55")
text("agg_distinct", "MATCH (c:Customer) RETURN count(DISTINCT c.c_mktsegment) AS n, sum(DISTINCT c.c_nationkey) AS s, avg(DISTINCT c.c_nationkey) AS a", "SELECT count(DISTINCT c_mktsegment) AS n, sum(DISTINCT c_nationkey)::BIGINT AS s, avg(DISTINCT c_nationkey) AS a FROM customer")
text("agg_output_expr", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, 1 + count(*) AS n, max(c.c_acctbal) - min(c.c_acctbal) AS d", "SELECT c_mktsegment AS s, 1 + count(*) AS n, max(c_acctbal) - min(c_acctbal) AS d FROM customer GROUP BY 1")
text("agg_stddev", "MATCH (p:Part) RETURN round(stddev_samp(p.p_size), 6) AS a, round(stddev_pop(p.p_size), 6) AS b", "SELECT round(stddev_samp(p_size), 6) AS a, round(stddev_pop(p_size), 6) AS b FROM part")
text("agg_percentile", "MATCH (p:Part) RETURN p.p_brand AS b, percentile_cont(p.p_size, 0.25) AS c, percentile_disc(p.p_size, 0.25) AS d", "SELECT p_brand AS b, quantile_cont(p_size, 0.25) AS c, quantile_disc(p_size, 0.25) AS d FROM part GROUP BY 1")
text("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, collect_list(n.n_nationkey) AS l NEXT RETURN r, array_join(array_sort(l), ',') AS l", "SELECT r_name AS r, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
text("agg_factorized_count", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
text("agg_factorized_path", "MATCH (p:Part)<-[:CONTAINS]-(o:Orders)-[:SUPPLIED_BY]->(s:Supplier) RETURN count(*) AS n", "SELECT sum(k * k)::BIGINT AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey)")


@operator("SELECT sum(c)::BIGINT AS count FROM (SELECT count(*) * count(*) AS c FROM lineitem GROUP BY l_orderkey)")
def factorized_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return relational.aggregate_product("COUNT", ["l_orderkey"], [li.select("l_orderkey", "l_partkey"), li.select("l_orderkey", "l_suppkey")])


@operator("SELECT sum(q * n)::DOUBLE AS sum FROM (SELECT sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def factorized_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return relational.aggregate_product("SUM", ["l_orderkey"], [li.select("l_orderkey", "l_suppkey")], li, F.col("l_quantity"))


@operator("SELECT min(l_quantity) AS min FROM lineitem")
def factorized_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return relational.aggregate_product("MIN", ["l_orderkey"], [li.select("l_orderkey", "l_suppkey")], li, F.col("l_quantity"))


@operator("SELECT sum(q * n) / sum(c * n) AS avg FROM (SELECT sum(l_quantity) AS q, count(l_quantity) AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def factorized_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over nested columns, as an expansion leaves them."""
    li = table(spark, sf_dir, "lineitem")
    a = relational.factorize(li.select("l_orderkey", "l_quantity"), ["l_orderkey"], "parts")
    b = relational.factorize(li.select("l_orderkey", "l_suppkey"), ["l_orderkey"], "suppliers")
    return relational.factorized_aggregate(a.join(b, "l_orderkey"), ["parts", "suppliers"], "AVG", lambda x: x["l_quantity"], "parts")


@operator("SELECT l_orderkey, l_quantity * 2 AS q FROM lineitem WHERE l_quantity > 25")
def factorized_filter_project_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    f = relational.factorize(li.select("l_orderkey", "l_quantity"), ["l_orderkey"], "parts")
    f = relational.factorized_filter(f, "parts", lambda x: x["l_quantity"] > 25)
    f = relational.factorized_project(f, "parts", lambda x: F.struct((x["l_quantity"] * 2).alias("q")), "parts")
    return relational.flatten(f, "parts")


# -- order and paging
text("sort_multi_nulls", "MATCH (e:Event) RETURN e.event_type AS t, e.value AS v, e.event_id AS k ORDER BY t DESC, v ASC, k LIMIT 50", "SELECT event_type AS t, value AS v, event_id AS k FROM events ORDER BY t DESC NULLS LAST, v ASC NULLS LAST, k LIMIT 50")
text("sort_nulls_first", "MATCH (e:Event) RETURN e.value AS v, e.event_id AS k ORDER BY v NULLS FIRST, k DESC LIMIT 20", "SELECT value AS v, event_id AS k FROM events ORDER BY v ASC NULLS FIRST, k DESC LIMIT 20")
text("sort_by_input", "MATCH (o:Orders) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, k LIMIT 15", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, k LIMIT 15")
text("limit_topk", "MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 7", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 7")
text("offset_limit", "MATCH (o:Orders) WHERE o.o_orderstatus = 'O' RETURN o.o_orderkey AS k ORDER BY k OFFSET 5 LIMIT 10", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' ORDER BY k LIMIT 10 OFFSET 5")
text("order_statement", "MATCH (o:Orders) ORDER BY o.o_totalprice, o.o_orderkey LIMIT 5 RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
text("limit_approximate", "MATCH (o:Orders) RETURN o.o_orderkey AS k ORDER BY k LIMIT 4 APPROXIMATE", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 4")

# -- set operations
_A, _B = "MATCH (c:Customer) RETURN c.c_nationkey AS k", "MATCH (s:Supplier) RETURN s.s_nationkey AS k"
_a, _b = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("except_all", "EXCEPT ALL"), ("except_distinct", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("intersect_distinct", "INTERSECT DISTINCT")):
    text(_name, f"{_A} {_op} {_B}", f"{_a} {_op.replace(' DISTINCT', '')} {_b}")
text("otherwise", "MATCH (n:Nation) WHERE n.n_nationkey < 0 RETURN n.n_name AS x OTHERWISE MATCH (r:Region) RETURN r.r_name AS x", "SELECT r_name AS x FROM region")
text("otherwise_left", "MATCH (n:Nation) RETURN n.n_name AS x OTHERWISE MATCH (r:Region) RETURN r.r_name AS x", "SELECT n_name AS x FROM nation")

# -- scalar functions
text("arith_int_div", "MATCH (n:Nation) RETURN n.n_nationkey AS k, (n.n_nationkey + 7) / 3 AS q, n.n_nationkey % 4 AS m, -n.n_nationkey AS g", "SELECT n_nationkey AS k, ((n_nationkey + 7) // 3)::BIGINT AS q, n_nationkey % 4 AS m, -n_nationkey AS g FROM nation")
text("concat", "MATCH (n:Nation) RETURN n.n_name || '-' || n.n_name AS c", "SELECT n_name || '-' || n_name AS c FROM nation")
text("xor", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey > 5 XOR n.n_regionkey > 2 AS x", "SELECT n_nationkey AS k, (n_nationkey > 5) <> (n_regionkey > 2) AS x FROM nation")
text("case_when", "MATCH (n:Nation) RETURN n.n_nationkey AS k, CASE WHEN n.n_nationkey < 5 THEN 'low' WHEN n.n_nationkey < 15 THEN 'mid' ELSE 'high' END AS c, CASE n.n_regionkey WHEN 0 THEN 'zero' END AS d", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 15 THEN 'mid' ELSE 'high' END AS c, CASE n_regionkey WHEN 0 THEN 'zero' END AS d FROM nation")
text("coalesce_nullif", "MATCH (n:Nation) RETURN n.n_nationkey AS k, coalesce(nullif(n.n_regionkey, 2), 99) AS c", "SELECT n_nationkey AS k, coalesce(nullif(n_regionkey, 2), 99) AS c FROM nation")
text("char_byte_length", "RETURN char_length('aé') AS c, byte_length('aé') AS b, octet_length('xyz') AS o, character_length('') AS z", "SELECT length('aé')::INT AS c, octet_length(encode('aé'))::INT AS b, 3 AS o, 0 AS z")
text("abs", "MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a", "SELECT c_custkey AS k, abs(c_acctbal) AS a FROM customer")
text("is_truth", "MATCH (e:Event) RETURN e.event_id AS k, (e.value > 50) IS TRUE AS t, (e.value > 50) IS NOT FALSE AS f, (e.value > 50) IS UNKNOWN AS u", "SELECT event_id AS k, coalesce(value > 50, FALSE) AS t, coalesce(value > 50, TRUE) AS f, (value > 50) IS NULL AS u FROM events")
text("temporal", "MATCH (o:Orders) WHERE o.o_orderdate >= DATE '1995-01-01' AND o.o_orderdate < DATE '1995-01-01' + DURATION 'P40D' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-01-01' + INTERVAL 40 DAY")
text("list_record", "MATCH (n:Nation) LET l = [n.n_nationkey, n.n_regionkey], r = RECORD {a: n.n_name, b: 1} RETURN size(l) AS s, l[1] AS x, r.a AS a", "SELECT 2 AS s, n_regionkey AS x, n_name AS a FROM nation")
text("cast_typed", "MATCH (n:Nation) RETURN CAST(n.n_nationkey AS STRING) AS s, n.n_name IS TYPED STRING AS t", "SELECT n_nationkey::VARCHAR AS s, TRUE AS t FROM nation")
text("literals", "RETURN 0x1F AS h, 0b101 AS b, 1.5e2 AS f, 'it''s' AS s, NULL IS NULL AS n, SESSION_USER AS u", "SELECT 31 AS h, 5 AS b, 150.0::DOUBLE AS f, 'it''s' AS s, TRUE AS n, 'user' AS u")
text("all_different_same", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN all_different(a, b) AS d, same(a, b) AS s, property_exists(a, n_name) AS p, count(*) AS n", "SELECT a.n_nationkey <> b.n_nationkey AS d, a.n_nationkey = b.n_nationkey AS s, TRUE AS p, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1, 2, 3")
text("element_functions", "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN type(e) AS t, labels(n)[0] AS l, properties(n).n_name AS p, id(n) AS i", "SELECT 'IN_REGION' AS t, 'Nation' AS l, n_name AS p, n_nationkey::BIGINT AS i FROM nation")
text("spark_functions", "MATCH (n:Nation) RETURN upper(n.n_name) AS u, length(n.n_name) AS l, md5(n.n_name) AS m", "SELECT upper(n_name) AS u, length(n_name)::INT AS l, md5(n_name) AS m FROM nation")

# -- vectors
_Q = ", ".join(str(round(((i * 37) % 17 - 8) / 40, 3)) for i in range(64))
_L2 = f"list_sum(list_transform(list_zip(embedding, [{_Q}]::FLOAT[]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
text("vector_distance", f"MATCH (v:Vec) RETURN v.vec_id AS k, round(vector_distance(v.embedding, VECTOR[{_Q}]), 4) AS d", f"SELECT vec_id AS k, round(sqrt({_L2})::FLOAT, 4) AS d FROM embeddings")
text("vector_topk", f"MATCH (v:Vec) RETURN v.vec_id AS k ORDER BY vector_distance(v.embedding, VECTOR[{_Q}]), k LIMIT 10 APPROXIMATE", f"SELECT vec_id AS k FROM embeddings ORDER BY sqrt({_L2})::FLOAT, k LIMIT 10")
text("vector_filtered_topk", f"MATCH (v:Vec) WHERE v.label = 2 RETURN v.vec_id AS k ORDER BY vector_distance(v.embedding, VECTOR[{_Q}], EUCLIDEAN), k LIMIT 5", f"SELECT vec_id AS k FROM embeddings WHERE label = 2 ORDER BY sqrt({_L2})::FLOAT, k LIMIT 5")


@operator(f"SELECT vec_id AS vid, round({_L2}, 6) AS distance FROM embeddings ORDER BY {_L2}, vid LIMIT 8")
def vector_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.gql("CREATE VECTOR INDEX vecs FOR (v:Vec) ON (v.embedding)")
    found = vector.index_scan(s.graph, "vecs", [float(x) for x in _Q.split(", ")], 8)
    return found.select("vid", F.round("distance", 6).alias("distance"))


@operator()
def vector_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables_graph(spark, sf_dir).vertices["Vec"].df
    asked = v.where(F.col(VID) % 100 == 0).select(F.col(VID).alias("qid"), "embedding")
    return vector.nearest_approximate(v, "embedding", asked, 10, 64)


# -- joins
@operator("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey IS NOT DISTINCT FROM s_nationkey")
def join_inner_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return relational.hash_join(c, s, [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


@operator("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    right = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return relational.hash_join(li.select("l_orderkey", "l_linenumber"), right, [("l_orderkey", "o"), ("l_linenumber", "n")]).select("l_orderkey", "l_linenumber", F.col("q").alias("l_quantity"))


@operator("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hash_join(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), [])


# -- pattern statistics
@operator('SELECT o_custkey AS "_vid", count(*) AS degree FROM orders GROUP BY 1')
def degree_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.degrees(tables_graph(spark, sf_dir), "Customer", "PLACED", "out")


@operator('SELECT o_custkey AS "_vid", count(*) AS degree FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1')
def degree_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.path_degrees(tables_graph(spark, sf_dir), [("Customer", "PLACED", "out"), ("Orders", "CONTAINS", "out")])


@operator('SELECT l_orderkey AS "_vid", count(*) * count(*) AS degree FROM lineitem GROUP BY 1')
def star_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.star_degrees(tables_graph(spark, sf_dir), "Orders", [("CONTAINS", "out"), ("SUPPLIED_BY", "out")])


@operator("SELECT CASE WHEN k <= 1 THEN 0 ELSE ceil(log2(k)) END::INT AS bucket, count(*) AS vertices, max(k) AS largest FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_partkey) GROUP BY 1")
def degree_histogram_base2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.histogram(patterns.degrees(tables_graph(spark, sf_dir), "Part", "CONTAINS", "in"))


@operator(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NULL) AS nulls, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.column_stats(table(spark, sf_dir, "customer")).drop("ndv")  # approximate


@operator("SELECT 'c_custkey' AS \"column\", TRUE AS close UNION ALL SELECT 'c_name', TRUE UNION ALL SELECT 'c_nationkey', TRUE UNION ALL SELECT 'c_acctbal', TRUE UNION ALL SELECT 'c_mktsegment', TRUE")
def column_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate numbers of distinct values are within a fifth of the exact ones."""
    customer = table(spark, sf_dir, "customer")
    exact = customer.agg(*[F.count_distinct(c).alias(c) for c in customer.columns])
    stats = patterns.column_stats(customer).crossJoin(exact)
    true = F.coalesce(*[F.when(F.col("column") == c, F.col(c)) for c in customer.columns])
    return stats.select("column", (F.abs(F.col("ndv") - true) <= 0.2 * true).alias("close"))


_TREE = {"vertices": [{"id": 0, "label": "Customer"}, {"id": 1, "label": "Orders"}, {"id": 2, "label": "Part"}, {"id": 3, "label": "Nation"}], "edges": [{"id": 0, "label": "PLACED", "src": 0, "dst": 1}, {"id": 1, "label": "CONTAINS", "src": 1, "dst": 2}, {"id": 2, "label": "IN_NATION", "src": 0, "dst": 3}], "predicates": [{"target": "vertex", "id": 0, "property": "c_acctbal", "op": "gt", "value": 0.0}]}
_CYCLE = {"vertices": [{"id": 0, "label": "Orders"}, {"id": 1, "label": "Part"}, {"id": 2, "label": "Supplier"}], "edges": [{"id": 0, "label": "CONTAINS", "src": 0, "dst": 1}, {"id": 1, "label": "SUPPLIED_BY", "src": 0, "dst": 2}]}


@operator("SELECT count(*) AS cardinality FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 0")
def exact_pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.exact_count(tables_graph(spark, sf_dir), patterns.Pattern.parse(_TREE))


@operator("SELECT count(*) AS cardinality FROM (SELECT DISTINCT a.l_orderkey AS x, 1 FROM lineitem a) t, LATERAL (SELECT 1 FROM lineitem b, lineitem c WHERE b.l_orderkey = x AND c.l_orderkey = x)")
def exact_star_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.exact_count(tables_graph(spark, sf_dir), patterns.Pattern.parse(_CYCLE))


_TRUTH = "SELECT count(*) AS truth, TRUE AS good FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"
_FREE = _TREE | {"predicates": []}


@operator(_TRUTH)
def cardinality_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upper bound of a tree pattern without predicates, beside the truth."""
    s = session(spark, sf_dir)
    bound = s.gql(f"CALL gcard_query('{json.dumps(_FREE)}', 2, 1000)")
    return patterns.exact_count(s.graph, patterns.Pattern.parse(_FREE)).withColumnRenamed("cardinality", "truth").crossJoin(bound).select("truth", (F.col("cardinality") >= F.col("truth")).alias("good"))


@operator(_TRUTH + " WHERE c_acctbal > 0")
def wander_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate from walks over the whole of the first table, which is to be within a quarter of the truth."""
    s = session(spark, sf_dir)
    walked = s.gql(f"CALL wander_join_query('{json.dumps(_TREE)}', 1.0, 1, 7)")
    truth = patterns.exact_count(s.graph, patterns.Pattern.parse(_TREE)).withColumnRenamed("cardinality", "truth")
    return truth.crossJoin(walked).select("truth", (F.abs(F.col("cardinality") - F.col("truth")) <= 0.25 * F.col("truth")).alias("good"))


def _walks_sql() -> str:
    """Histograms of all walks of one or two edges over the tables graph, by plain joins."""
    edges = [("IN_REGION", "Nation", "Region", "SELECT n_nationkey AS a, n_regionkey AS b FROM nation"), ("IN_NATION", "Customer", "Nation", "SELECT c_custkey AS a, c_nationkey AS b FROM customer"),
             ("IN_NATION", "Supplier", "Nation", "SELECT s_suppkey AS a, s_nationkey AS b FROM supplier"), ("PLACED", "Customer", "Orders", "SELECT o_custkey AS a, o_orderkey AS b FROM orders"),
             ("CONTAINS", "Orders", "Part", "SELECT l_orderkey AS a, l_partkey AS b FROM lineitem"), ("SUPPLIED_BY", "Orders", "Supplier", "SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem"),
             ("DID", "User", "Event", "SELECT user_id AS a, event_id AS b FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL")]
    hops: dict[tuple[str, str, str], list[tuple[str, str]]] = {}  # (from, label, way): where to, and the edges
    for label, src, dst, sql in edges:
        hops.setdefault((src, label, "out"), []).append((dst, f"SELECT a AS x, b AS y, '{dst}' AS t FROM ({sql})"))
        hops.setdefault((dst, label, "in"), []).append((src, f"SELECT b AS x, a AS y, '{src}' AS t FROM ({sql})"))
    every = {k: " UNION ALL ".join(sql for _, sql in v) for k, v in hops.items()}
    parts = []
    for (v, e, _), sql in every.items():
        for to in dict.fromkeys(t for t, _ in hops[v, e, _]):
            parts.append((_key([v, e, to]), v, f"SELECT x, count(*) AS k FROM ({sql}) GROUP BY x"))
            for (v2, e2, way2), sql2 in every.items():
                if v2 == to:
                    # the second hop is open at every vertex of its label that the first one reaches
                    joined = f"SELECT p.x, count(*) AS k FROM ({sql}) p JOIN ({sql2}) q ON p.y = q.x GROUP BY p.x"
                    parts += [(_key([v, e, to, e2, t2]), v, joined) for t2 in dict.fromkeys(t for t, _ in hops[v2, e2, way2])]
    one = "SELECT '{}' AS path, '{}' AS label, CASE WHEN k <= 1 THEN 0 ELSE ceil(log2(k)) END::INT AS bucket, count(*) AS vertices, max(k) AS largest FROM ({}) GROUP BY 3"
    return " UNION ALL ".join(one.format(*p) for p in parts)


def _key(labels: list[str]) -> str:
    low = [x.lower() for x in labels]
    return "/".join(min(low, low[::-1]))


@operator(_walks_sql())
def degree_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).gql("CALL create_catalog(2)")


# -- procedures, mutation, files
text("call_echo", "CALL echo('hello') YIELD output RETURN output AS x", "SELECT 'hello' AS x")
text("call_show_graph", "CALL show_graph() YIELD graph_name AS g RETURN g", "SELECT 'tables' AS g")
text("call_show_procedures", "CALL show_procedures() YIELD name, params RETURN name", "SELECT unnest(string_split('echo show_procedures show_graph create_test_graph create_test_graph_data create_test_vector_graph_data import_graph export_graph build_ldbc_manifest mutate_graph load_ldbc load_flatgraph create_catalog load_catalog gcard_query wander_join_query set_gcard_star_config compact_gcard_log gcard_stat_quality random_update random_insert export_edge_csv export_flatgraph_snapshot gcard_snapshot gcard_restore', ' ')) AS name")
text("call_inline", "MATCH (r:Region) CALL { MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.n_name AS x } RETURN r.r_name AS r, x", "SELECT r_name AS r, n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey")
text("call_inline_aggregate", "MATCH (r:Region) CALL { MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey < 13 RETURN count(*) AS k, sum(n.n_nationkey) AS s } RETURN r.r_name AS r, k, s", "SELECT r_name AS r, count(n_nationkey) AS k, sum(n_nationkey)::BIGINT AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 13 GROUP BY 1")
text("call_inline_limit", "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.c_custkey AS c ORDER BY c.c_acctbal DESC, c LIMIT 2 } RETURN n.n_name AS n, c", "SELECT n_name AS n, c FROM (SELECT n_name, c_custkey AS c, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE k <= 2")
text("call_optional", "FOR x IN [5, 24, 30] OPTIONAL CALL { MATCH (n:Nation) WHERE n.n_nationkey >= x RETURN n.n_nationkey AS k } RETURN x, coalesce(k, -1) AS k", "SELECT x, coalesce(n_nationkey, -1) AS k FROM (VALUES (5), (24), (30)) t(x) LEFT JOIN nation ON n_nationkey >= x")
text("duration_between", "MATCH (o:Orders) WHERE duration_between(TIMESTAMP '1995-06-01T00:00:00', o.o_orderdate) > DURATION 'P300D' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate - TIMESTAMP '1995-06-01 00:00:00' > INTERVAL 300 DAY")
text("path_constructor", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) LET p = PATH[n, e, r] RETURN path_length(p) AS l, nodes(p)[1].id AS r, relationships(p)[0].id AS e", "SELECT 1::BIGINT AS l, n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS e FROM nation")
text("parameters", "SESSION SET VALUE $low = 5; SESSION SET VALUE $few = 3; MATCH (n:Nation) WHERE n.n_nationkey > $low RETURN n.n_nationkey AS k ORDER BY k LIMIT $few", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 5 ORDER BY k LIMIT 3")
text("drop_vector_index", "CREATE VECTOR INDEX vecs FOR (v:Vec) ON (v.embedding); DROP VECTOR INDEX vecs; CREATE VECTOR INDEX vecs FOR (v:Vec) ON (v.embedding); MATCH (v:Vec) RETURN count(*) AS n", "SELECT count(*) AS n FROM embeddings")
text("transaction_rollback", "START TRANSACTION; CALL mutate_graph('tables', 'delete_vertices', 'Region', NULL, NULL, 2); ROLLBACK; MATCH (r:Region) RETURN r.r_name AS r", "SELECT r_name AS r FROM region")
text("snapshot_restore", "CALL gcard_snapshot(); CALL mutate_graph('tables', 'delete_vertices', 'Nation', NULL, NULL, 9); CALL gcard_restore(); MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
text("load_flatgraph", "CALL load_flatgraph('tables'); MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")


@operator("SELECT count(*) + 20 AS n FROM orders")
def mutate_add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.gql("CALL mutate_graph('tables', 'add_edges', 'Customer', 'Orders', 'PLACED', 20)")
    return s.gql("MATCH (c:Customer)-[e:PLACED]->(o:Orders) RETURN count(*) AS n")


@operator("SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10) GROUP BY 1")
def mutate_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.gql("CALL mutate_graph('tables', 'delete_vertices', 'Customer', NULL, NULL, 10)")
    return s.gql("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS c, count(*) AS n")


@operator("SELECT (SELECT max(r_regionkey) FROM region)::BIGINT + i AS k FROM range(1, 4) t(i)")
def mutate_add_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mutate.add_vertices(tables_graph(spark, sf_dir), "Region", 3)
    return g.vertices["Region"].df.where("r_name IS NULL").select(F.col(VID).alias("k"))


@operator("SELECT (SELECT count(*) FROM nation) AS vertices, 0::BIGINT AS edges, 0::BIGINT AS left_nations, 0::BIGINT AS left_edges")
def random_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of one: all vertices of a label go, with the edges at them."""
    s = session(spark, sf_dir)
    done = s.gql("CALL random_update(1.0, NULL, 3, 'Nation', NULL)")
    left = s.gql("MATCH (n:Nation) RETURN count(*) AS left_nations").crossJoin(s.gql("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN count(*) AS left_edges"))
    return done.crossJoin(left)


@operator("SELECT 2 * count(*) AS n, count(DISTINCT c_custkey) AS c FROM customer")
def random_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of one: every edge of a label comes a second time, under a new id."""
    s = session(spark, sf_dir)
    s.use_graph(Graph("small", {k: s.graph.vertices[k] for k in ("Customer", "Nation")}, tuple(e for e in s.graph.edges if e.src_label == "Customer" and e.dst_label == "Nation")))
    s.gql("CALL random_insert(1.0, NULL, 3, NULL, 'IN_NATION')")
    return s.gql("MATCH (c:Customer)-[e:IN_NATION]->(n:Nation) RETURN count(DISTINCT e) AS n, count(DISTINCT c) AS c")


_JOINED = "SELECT n_name AS n, r_name AS r, c_custkey AS c, o_orderkey AS o, o_orderdate AS d, l_linenumber AS l, p_partkey AS p, s_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@operator(_JOINED)
def import_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without vectors, which the manifest has no type for, through CSV files and back."""
    g = tables_graph(spark, sf_dir)
    whole = Graph("whole", {k: v for k, v in g.vertices.items() if k != "Vec"}, g.edges)
    folder = _folder(spark, "export")
    export_graph(spark, whole, folder)
    s = Session(spark).use_graph(import_graph(spark, "whole", f"{folder}/manifest.json"))
    return s.gql("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders)-[e:CONTAINS]->(p:Part), (o)-[f:SUPPLIED_BY]->(s:Supplier) WHERE id(e) = id(f) RETURN n.n_name AS n, r.r_name AS r, c.c_custkey AS c, o.o_orderkey AS o, o.o_orderdate AS d, e.l_linenumber AS l, p.p_partkey AS p, s.s_acctbal AS b")


@operator("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "snapshot")
    session(spark, sf_dir).gql(f"CALL export_flatgraph_snapshot('{folder}')")
    return Session(spark).use_graph(load_snapshot(spark, folder, "tables")).gql("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


@operator("SELECT s_suppkey::VARCHAR AS s, s_nationkey::VARCHAR AS d FROM supplier")
def export_edge_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "edges")
    session(spark, sf_dir).gql(f"CALL export_edge_csv('{folder}')")
    return spark.read.csv(f"{folder}/Supplier_IN_NATION_Nation.csv", header=True).toDF("s", "d")


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Nations and regions as separated files by label, the way such data sets come."""
    folder = _folder(spark, "csv")
    nation = table(spark, sf_dir, "nation")
    for name, df in (("Region", table(spark, sf_dir, "region")), ("Nation", nation.select("n_nationkey", "n_name", (F.col("n_nationkey") / 2).alias("half"))), ("Nation_INREGION_Region", nation.select("n_nationkey", "n_regionkey"))):
        df.write.csv(f"{folder}/{name}.csv", header=True, sep="|")
    return folder


@operator("SELECT 'Nation' AS label, 'n_name' AS name, 'String' AS kind UNION ALL SELECT 'Nation', 'half', 'Float64' UNION ALL SELECT 'Region', 'r_name', 'String'")
def build_ldbc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _csv_folder(spark, sf_dir)
    session(spark, sf_dir).gql(f"CALL build_ldbc_manifest('{folder}', '{folder}/manifest.json')")
    made = json.loads(read_text(spark, f"{folder}/manifest.json"))
    return spark.createDataFrame([(v["label"], p["name"], p["logical_type"]) for v in made["vertices"] for p in v["properties"]], "label string, name string, kind string")


@operator("SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r, n_name AS x FROM nation")
def load_ldbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.gql(f"CALL load_ldbc('{_csv_folder(spark, sf_dir)}', 'csv', 1)")
    return s.gql("MATCH (n:Nation)-[:INREGION]->(r:Region) RETURN id(n) AS n, id(r) AS r, n.n_name AS x")


@operator("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.degrees import windowed_activity

    return windowed_activity(table(spark, sf_dir, "events")).select("start", "event_type", "n")


text("fixture_people", "CALL create_test_graph_data('g', 10); SESSION SET GRAPH g; MATCH (p:PERSON)-[f:FRIEND]->(q:PERSON) RETURN p.name AS p, q.name AS q, f.distance AS d", "SELECT 'person' || a AS p, 'person' || b AS q, (a + b)::INT AS d FROM range(5) t(a), range(5) u(b)")
