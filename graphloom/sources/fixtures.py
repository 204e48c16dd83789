"""Generated graphs for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import DST, EID, SRC, VID, EdgeSet, Graph, VertexSet


def people_graph(spark: SparkSession, name: str, n: int) -> Graph:
    """People who all know each other, companies they work at, and cities these are in."""
    p, c = max(n // 2, 1), max(n // 4, 1)
    i = F.col("id")
    word = lambda w: F.concat(F.lit(w), i.cast("string"))
    person = spark.range(p).select(i.alias(VID), word("person").alias("name"), (i + 20).cast("tinyint").alias("age"))
    company = spark.range(c).select((i + p).alias(VID), word("company").alias("name"), ((i + 1) * 1000000).alias("revenue"))
    city = spark.range(c).select((i + p + c).alias(VID), word("city").alias("name"), ((i + 1) * 100000).cast("int").alias("population"))
    a, b = F.floor(i / p), i % p
    friend = spark.range(p * p).select(i.alias(EID), a.alias(SRC), b.alias(DST), (a + b).cast("int").alias("distance"))
    workers = max(3 * p // 5, 1)
    works = spark.range(workers).select((i + p * p).alias(EID), i.alias(SRC), (i % c + p).alias(DST), (i % 5 + 2020).cast("int").alias("since"))
    located = spark.range(c).select((i + p * p + workers).alias(EID), (i + p).alias(SRC), (i % c + p + c).alias(DST), word("address").alias("address"))
    vertices = {x: VertexSet(x, df, frozenset(df.columns) - {VID}) for x, df in (("PERSON", person), ("COMPANY", company), ("CITY", city))}
    return Graph(name, vertices, (EdgeSet("FRIEND", "PERSON", "PERSON", friend), EdgeSet("WORKS_AT", "PERSON", "COMPANY", works), EdgeSet("LOCATED_IN", "COMPANY", "CITY", located)))


def vector_graph(spark: SparkSession, name: str, n: int) -> Graph:
    """People with two vectors; component j of vertex i is (i + j) / 100."""
    i = F.col("id")
    vector = lambda d: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: ((i + j) / 100).cast("float"))
    df = spark.range(n).select(i.alias(VID), F.concat(F.lit("person"), i.cast("string")).alias("name"), vector(104).alias("embedding"), vector(105).alias("embedding105"))
    return Graph(name, {"PERSON": VertexSet("PERSON", df)})
