"""Graphs as files: a JSON manifest with one table per label, as CSV or Parquet.

{"vertices": [{"label", "file": {"path", "format"}, "properties": [{"name", "logical_type", "nullable"}]}],
 "edges": [{"label", "src_label", "dst_label", "file", "properties"}]}; vertex rows are vid and properties, edge rows
eid, src, dst and properties, in order.  Paths are relative to the manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import DST, EID, SRC, VID, EdgeSet, Graph, GraphFault, VertexSet
from ..scratch import written
from .files import listed, read_text, write_text

LOGICAL = {"Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "Boolean": T.BooleanType(), "String": T.StringType(), "Date": T.DateType(), "Timestamp": T.TimestampType(), "LocalTimestamp": T.TimestampNTZType(), "Vector": T.ArrayType(T.FloatType())}
_NAMES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "boolean": "Boolean", "string": "String", "date": "Date", "timestamp": "Timestamp", "timestamp_ntz": "LocalTimestamp", "array<float>": "Vector"}


def _schema(ids: list[str], properties: list[dict]) -> T.StructType:
    fields = [T.StructField(i, T.LongType(), False) for i in ids]
    for p in properties:
        kind = p["logical_type"]
        if not isinstance(kind, str) or kind not in LOGICAL:
            raise GraphFault(f"type {kind} can't be imported")
        fields.append(T.StructField(p["name"], LOGICAL[kind], True))
    return T.StructType(fields)


def _read(spark: SparkSession, base: str, entry: dict, ids: list[str], header: bool) -> DataFrame:
    file, properties = entry["file"], entry.get("properties", [])
    schema, path = _schema(ids, properties), f"{base}/{file['path']}"
    if file.get("format", "csv").lower() == "parquet":
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    if any(p["logical_type"] == "Vector" for p in properties):
        raise GraphFault("vectors can't be imported from CSV, only from Parquet")
    df = spark.read.csv(path, schema=schema, header=header, mode="FAILFAST", enforceSchema=True, nullValue="", emptyValue="")
    for p in properties:
        if not p.get("nullable", True):
            empty = F.raise_error(F.lit(f"{entry['label']}.{p['name']} is empty but not nullable"))
            df = df.withColumn(p["name"], F.when(F.col(p["name"]).isNull(), empty.cast(LOGICAL[p["logical_type"]])).otherwise(F.col(p["name"])))
    return df


def import_graph(spark: SparkSession, name: str, manifest_path: str, header: bool = True) -> Graph:
    """The graph that a manifest describes.  CSV files have a header line unless `header` is False."""
    base = manifest_path.rpartition("/")[0] or "."
    manifest = json.loads(read_text(spark, manifest_path))
    vertices = {}
    for v in manifest["vertices"]:
        if v["label"] in vertices:
            raise GraphFault(f"vertex label {v['label']} occurs twice")
        required = frozenset(p["name"] for p in v.get("properties", []) if not p.get("nullable", True))
        vertices[v["label"]] = VertexSet(v["label"], _read(spark, base, v, [VID], header), required)
    edges = []
    for e in manifest["edges"]:
        for end in (e["src_label"], e["dst_label"]):
            if end not in vertices:
                raise GraphFault(f"edge {e['label']} has the unknown end {end}")
        edges.append(EdgeSet(e["label"], e["src_label"], e["dst_label"], _read(spark, base, e, [EID, SRC, DST], header)))
    return Graph(name, vertices, tuple(edges), closed=False)


def _properties(df: DataFrame, ids: list[str], required: frozenset[str]) -> list[dict]:
    out = []
    for c, kind in df.dtypes:
        if c not in ids:
            if kind not in _NAMES:
                raise GraphFault(f"type {kind} of {c} can't be exported")
            out.append({"name": c, "logical_type": _NAMES[kind], "nullable": c not in required})
    return out


def export_graph(spark: SparkSession, graph: Graph, folder: str, manifest: str = "manifest.json", kind: str = "csv") -> None:
    """Writes tables and manifest so that import_graph gives the graph back."""
    out: dict[str, list] = {"vertices": [], "edges": []}
    items = [("vertices", v, [VID], v.label) for v in graph.vertices.values()] + [("edges", e, [EID, SRC, DST], f"{e.label}_{e.src_label}_{e.dst_label}") for e in graph.edges]
    for group, item, ids, name in items:
        file = f"{name}.{kind}"
        df = item.df.select(*ids, *[F.col(f"`{c}`") for c in item.properties])
        if kind == "csv" and any(t.startswith("array") for _, t in df.dtypes):
            raise GraphFault(f"vectors of {name} can't be exported as CSV, only as Parquet")
        (df.write.mode("overwrite").csv(f"{folder}/{file}", header=True, emptyValue='""') if kind == "csv" else df.write.mode("overwrite").parquet(f"{folder}/{file}"))
        entry = {"label": item.label, "file": {"path": file, "format": kind}, "properties": _properties(df, ids, item.required)}
        if group == "edges":
            entry |= {"src_label": item.src_label, "dst_label": item.dst_label}
        out[group].append(entry)
    write_text(spark, f"{folder}/{manifest}", json.dumps(out, indent=2))


def inferred_types(df: DataFrame, columns: list[str]) -> list[str]:
    """Int64, Float64, Boolean or String for each text column: the first that all of its values are (String where it has none)."""
    if not columns:
        return []
    c = {n: F.nullif(F.col(f"`{n}`"), F.lit("")) for n in columns}
    tests = {"Int64": lambda x: x.try_cast("long").isNotNull() & ~x.rlike("[.eE]"), "Float64": lambda x: x.try_cast("double").isNotNull(), "Boolean": lambda x: F.lower(x).isin("true", "false")}
    seen = df.agg(*[F.every(t(x) | x.isNull()).alias(f"{k}{i}") for i, x in enumerate(c.values()) for k, t in tests.items()], *[F.count(x).alias(f"n{i}") for i, x in enumerate(c.values())]).first()
    return [next((k for k in tests if seen[f"n{i}"] and seen[f"{k}{i}"]), "String") for i in range(len(columns))]


def build_manifest(spark: SparkSession, folder: str, target: str, sep: str = "|") -> dict:
    """A manifest for a folder of CSV files with headers: label.csv for vertices, src_edge_dst.csv for edges.

    A property's type is the narrowest one that all of its values have; the first column (two for edges) holds the ids.
    """
    out: dict[str, list] = {"vertices": [], "edges": []}
    for name, _ in listed(spark, folder):
        if not name.endswith(".csv"):
            continue
        stem = name[:-4].removesuffix("_0_0")
        head = spark.read.csv(f"{folder}/{name}", header=True, sep=sep)
        parts = stem.split("_")
        skip = 2 if len(parts) == 3 else 1
        properties = [{"name": c, "logical_type": t, "nullable": True} for c, t in zip(head.columns[skip:], inferred_types(head, head.columns[skip:]), strict=True)]
        entry = {"label": parts[1] if skip == 2 else stem, "file": {"path": name, "format": "csv"}, "properties": properties}
        if skip == 2:
            entry |= {"src_label": parts[0], "dst_label": parts[2]}
        out["edges" if skip == 2 else "vertices"].append(entry)
    write_text(spark, target, json.dumps(out, indent=2))
    return out


def load_csv_topology(spark: SparkSession, folder: str, name: str, sep: str = "|") -> Graph:
    """A graph of ids and properties straight from such a folder.  Edge ids number the rows, so equal rows are different edges;
    numbered edges are written once, as the numbers depend on how the file was split."""
    vertices, edges = {}, []
    for file, _ in listed(spark, folder):
        if not file.endswith(".csv"):
            continue
        parts = file[:-4].removesuffix("_0_0").split("_")
        df = spark.read.csv(f"{folder}/{file}", header=True, sep=sep, inferSchema=False)
        if len(parts) == 3:
            plain = df.toDF("_s", "_d", *df.columns[2:])  # both ends may have the same name
            df = written(plain.select(F.monotonically_increasing_id().alias(EID), F.col("_s").cast("long").alias(SRC), F.col("_d").cast("long").alias(DST), *[F.col(f"`{c}`") for c in df.columns[2:]]), "edges")
            edges.append(EdgeSet(parts[1], parts[0], parts[2], df))
        else:
            label = "_".join(parts)
            vertices[label] = VertexSet(label, df.select(F.col(df.columns[0]).cast("long").alias(VID), *[F.col(f"`{c}`") for c in df.columns[1:]]))
    return Graph(name, vertices, tuple(edges), closed=False)


def save_snapshot(spark: SparkSession, graph: Graph, folder: str) -> str:
    """A Parquet snapshot of one version; the catalog file in the folder is swapped last."""
    where = f"{folder}/{graph.name}-v{graph.version}"
    export_graph(spark, graph, where, kind="parquet")
    write_text(spark, f"{folder}/{graph.name}.json", json.dumps({"graph": graph.name, "version": graph.version, "manifest": f"{where}/manifest.json"}))
    return where


def load_snapshot(spark: SparkSession, folder: str, name: str) -> Graph:
    entry = json.loads(read_text(spark, f"{folder}/{name}.json"))
    g = import_graph(spark, name, entry["manifest"])
    return Graph(name, g.vertices, g.edges, g.closed, entry["version"])
