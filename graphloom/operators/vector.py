"""Vector search: exact top-k by a plain distance expression, filtered search, and index upkeep.

The distance is a JVM expression and top-k compiles to TakeOrderedAndProject, so each task keeps k rows and only those
meet; nothing is sorted whole.  For many queries at once, `nearest_approximate` compares blocks of queries with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import squared_distance
from ..graph import VID, Graph, GraphFault


def dimension(df: DataFrame, column: str) -> int:
    """The one dimension that the vectors of a column have."""
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        raise GraphFault(f"{column} isn't a vector")
    r = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if r["a"] is None:
        raise GraphFault(f"{column} has no vectors")
    if r["a"] != r["b"]:
        raise GraphFault(f"{column} mixes dimensions {r['a']} and {r['b']}")
    return r["a"]


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def search(vertices: DataFrame, column: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(vid, distance): the k nearest by squared Euclidean distance, ties by id; a condition is applied before the search.  A vector
    of another length than the query's is an error, a null one is passed over."""
    df = vertices if where is None else vertices.where(where)
    wrong = F.raise_error(F.concat(F.lit(f"a query of {len(query)} dimensions meets a vector of "), F.size(column).cast("string"))).cast("array<float>")
    vector = F.when(F.size(column) == len(query), F.col(column)).otherwise(wrong)
    df = df.where(F.col(column).isNotNull()).withColumn(column, vector).select(F.col(VID).alias("vid"), squared_distance(F.col(column), literal(query)).alias("distance"))
    return df.orderBy("distance", "vid").limit(k)


def index_scan(graph: Graph, index: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """Search through a declared index, which fixes label, property and dimension."""
    i = graph.indexes.get(index)
    if i is None:
        raise GraphFault(f"vector index {index} doesn't exist")
    if len(query) != i.dimension:
        raise GraphFault(f"the index has {i.dimension} dimensions, the query {len(query)}")
    return search(graph.vertices[i.label].df, i.property, query, k, where)


#: Bytes of query vectors that a scan of the data carries, and floats of a table of products in a task.
QUERY_BYTES, PRODUCTS = 32 << 20, 1 << 22


def _merge(best: tuple[np.ndarray, np.ndarray], row: np.ndarray, vid: np.ndarray, distance: np.ndarray) -> None:
    """Puts candidates (query row, vid, distance) among the k best of each row, in place."""
    ids, far = best
    rows, k = far.shape
    row, vid, distance = np.concatenate((np.repeat(np.arange(rows), k), row)), np.concatenate((ids.ravel(), vid)), np.concatenate((far.ravel(), distance))
    order = np.lexsort((vid, distance, row))
    begin = np.searchsorted(row[order], np.arange(rows))  # every row has k entries at least
    keep = order[(begin[:, None] + np.arange(k)).ravel()]
    ids[:], far[:] = vid[keep].reshape(rows, k), distance[keep].reshape(rows, k)


def nearest_blocks(batches: Iterator[pa.RecordBatch], qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, vid, distance) of the k nearest of each query among the rows (vid, v) of the batches.

    Products of blocks find the candidates, with a margin far above their rounding; the distances of those are summed in
    the order of the elements, as `squared_distance` does.
    """
    dim = q.shape[1]
    ids, far = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
    norm = (q * q).sum(axis=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        vid = np.asarray(batch.column("vid"), dtype=np.int64)
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        size = (v * v).sum(axis=1)
        step = max(1, PRODUCTS // len(v))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            total = norm[a : a + step, None] + size
            about = total - 2 * (part @ v.T)
            limit = far[a : a + step, -1]
            if len(v) > k:
                limit = np.minimum(limit, np.partition(about, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero(about - 1e-9 * total <= limit[:, None] * (1 + 1e-9) + 1e-9 * total)
            exact = np.zeros(len(row))
            for c in range(0, len(row), 1 << 15):
                gap = (part[row[c : c + (1 << 15)]] - v[col[c : c + (1 << 15)]]) ** 2
                for d in range(dim):
                    exact[c : c + (1 << 15)] += gap[:, d]
            _merge((ids[a : a + step], far[a : a + step]), row, vid[col], exact)
    row, col = np.nonzero(far < np.inf)
    return qid[row], ids[row, col], far[row, col]


def nearest_approximate(vertices: DataFrame, column: str, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(qid, vid, distance): for each query (qid, column) the k nearest vertices, ties by id.

    Vectors that are null or of another length than `dim` have no distance and are left out; `search` raises on such a length.
    Every query is compared with every vector of it, so nothing is missed and the work is the product of both counts.  A scan of the
    data takes a bounded block of queries with it and keeps k rows a query and task; more queries mean more scans.
    """
    spark = vertices.sparkSession
    whole = lambda df, name: df.where(F.size(column) == dim).select(F.col(name).cast("long").alias(name), F.col(column).cast("array<double>").alias("v"))
    most = max(1, QUERY_BYTES // (8 * dim))
    data = whole(vertices, VID).withColumnRenamed(VID, "vid").coalesce(4 * spark.sparkContext.defaultParallelism)
    asked = whole(queries, "qid").dropDuplicates(["qid"])
    blocks = -(-asked.count() // most) or 1

    def scan(block: DataFrame) -> DataFrame:
        got = block.toArrow()  # some `most` short rows
        q = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((got.column("qid").to_numpy(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = nearest_blocks(batches, *shared.value, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["qid", "vid", "distance"])

        return data.mapInArrow(run, "qid long, vid long, distance double")

    pairs = None
    for b in range(blocks):
        found = scan(asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b))
        pairs = found if pairs is None else pairs.unionByName(found)
    w = Window.partitionBy("qid").orderBy("distance", "vid")  # filtered to the first k: Spark keeps k a group and task first
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
