"""A graph over relational Parquet tables: customers, orders, parts, suppliers, places, events and vectors."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import DST, EID, SRC, VID, EdgeSet, Graph, VertexSet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_graph(spark: SparkSession, sf_dir: str, name: str = "tables") -> Graph:
    """The graph view; every frame is a projection of one table, so filters and columns reach its scan."""
    key = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Vec": ("embeddings", "vec_id")}

    @cache
    def t(n: str) -> DataFrame:
        return table(spark, sf_dir, n)

    def vertex(label: str, n: str, k: str) -> VertexSet:
        return VertexSet(label, lambda: t(n).withColumn(VID, F.col(k).cast("long")))

    vertices = {label: vertex(label, n, k) for label, (n, k) in key.items()}
    vertices["User"] = VertexSet("User", lambda: t("events").select(F.col("user_id").cast("long").alias(VID)).where(F.col(VID).isNotNull()).distinct())

    def edge(label: str, src: str, dst: str, n: str, eid: str, s: str, d: str, *props: str, host: str = "") -> EdgeSet:
        ends = (F.expr(eid).cast("long").alias(EID), F.col(s).cast("long").alias(SRC), F.col(d).cast("long").alias(DST))
        known = F.col(SRC).isNotNull() & F.col(DST).isNotNull()
        return EdgeSet(label, src, dst, lambda: t(n).select(*ends, *props).where(known), host=host, hosted=(lambda: t(n).select(*ends, "*").where(known)) if host else None)

    # lines have no key of their own; 62 bits, so that ids can go on after the largest
    line = "shiftrightunsigned(xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate), 2)"
    lines = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    edges = (
        edge("IN_REGION", "Nation", "Region", "nation", "n_nationkey", "n_nationkey", "n_regionkey", host="src"),
        edge("IN_NATION", "Customer", "Nation", "customer", "c_custkey", "c_custkey", "c_nationkey", host="src"),
        edge("IN_NATION", "Supplier", "Nation", "supplier", "s_suppkey", "s_suppkey", "s_nationkey", host="src"),
        edge("PLACED", "Customer", "Orders", "orders", "o_orderkey", "o_custkey", "o_orderkey", host="dst"),
        edge("CONTAINS", "Orders", "Part", "lineitem", line, "l_orderkey", "l_partkey", *lines),
        edge("SUPPLIED_BY", "Orders", "Supplier", "lineitem", line, "l_orderkey", "l_suppkey", *lines),
        edge("DID", "User", "Event", "events", "event_id", "user_id", "event_id", "ts", "value", host="dst"),
    )
    return Graph(name, vertices, edges)
