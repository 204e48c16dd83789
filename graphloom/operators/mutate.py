"""Bulk changes of a graph; each gives a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import DST, EID, SRC, VID, Graph, GraphFault
from ..scratch import written


def amount(count: int | None, percent: float | None, total: int) -> int:
    if (count is None) == (percent is None):
        raise GraphFault("give either a count or a percentage")
    return count if count is not None else int(total * percent / 100)


def add_vertices(g: Graph, label: str, n: int) -> Graph:
    """n vertices without properties; ids go on after the largest."""
    df = g.vertices[label].df
    top = df.agg(F.coalesce(F.max(VID), F.lit(-1)).alias("m"))
    rows = df.sparkSession.range(n).crossJoin(F.broadcast(top)).select((F.col("id") + F.col("m") + 1).alias(VID))
    return g.add_vertices(label, rows)


def delete_vertices(g: Graph, label: str, n: int) -> Graph:
    """The n vertices with the smallest ids, and the edges at them."""
    return g.delete_vertices(label, g.vertices[label].df.select(VID).orderBy(VID).limit(n))


def numbered(df: DataFrame, column: str, most: int) -> DataFrame:
    """(i, column) of the first `most` rows by value: rows past what n edges can use are never numbered."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each partition of the sorted rows numbers its own; the numbers before it are a sum over the few partition counts
    dealt = written(df.select(column).repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    needed = dealt.join(F.broadcast(before.where(F.col("_before") < most)), "_p")
    i = F.col("_before") + F.row_number().over(Window.partitionBy("_p", "_before").orderBy(column)) - 1
    return needed.select(F.col(column), i.cast("long").alias("i")).where(F.col("i") < most)


def add_edges(g: Graph, label: str, src: str, dst: str, n: int) -> Graph:
    """n edges that pair sources and targets round-robin; ids go on after the largest of all edges."""
    found = [e for e in g.edges if (e.label, e.src_label, e.dst_label) == (label, src, dst)]
    if not found:
        raise GraphFault(f"no edge {label} from {src} to {dst}")
    spark = found[0].df.sparkSession
    top = g.edge_frame().agg(F.coalesce(F.max(EID), F.lit(-1)).alias("m"))
    ends = []
    for name, v in (("s", src), ("d", dst)):
        total = g.vertices[v].df.count()
        if not total:
            raise GraphFault(f"{v} has no vertices")
        ends.append((name, total, numbered(g.vertices[v].df, VID, n)))
    rows = spark.range(n)
    for name, total, frame in ends:
        rows = rows.withColumn("i", F.col("id") % total).join(frame.withColumnRenamed(VID, name), "i").drop("i")
    rows = rows.crossJoin(F.broadcast(top)).select((F.col("id") + F.col("m") + 1).alias(EID), F.col("s").alias(SRC), F.col("d").alias(DST))
    return g.add_edges(label, src, dst, rows)


def random_part(df: DataFrame, ratio: float, seed: int) -> DataFrame:
    """A share of the rows, by a hash of seed and row: the same rows whenever it is read."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns[:3]]), F.lit(1 << 20)) < int(ratio * (1 << 20)))
