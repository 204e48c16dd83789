"""A database in a folder: its catalog as JSON, and each graph as Parquet snapshots."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .graph import Catalog, Graph, GraphFault
from .session import Session
from .sources.files import exists, read_text, write_text
from .sources.manifest import load_snapshot, save_snapshot


class Database:
    """Opens (or makes) a database.  `save` publishes a graph's version by one swap of the catalog file; what was not saved
    is gone when the database is opened anew.  `vacuum` drops the versions that the catalog no longer names."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.catalog = spark, folder.rstrip("/"), Catalog()
        if exists(spark, self._file):
            for schema, names in json.loads(read_text(spark, self._file)).items():
                self.catalog.schemas[schema] = {n: load_snapshot(spark, f"{self.folder}/{schema}", n) for n in names}

    @property
    def _file(self) -> str:
        return f"{self.folder}/catalog.json"

    def session(self, user: str = "user") -> Session:
        return Session(self.spark, self.catalog, user)

    def save(self, name: str, schema: str = "default") -> Graph:
        """Writes the graph's current version; from then on it is read from there."""
        g = self.catalog.graph(schema, name)
        save_snapshot(self.spark, g, f"{self.folder}/{schema}")
        stored = load_snapshot(self.spark, f"{self.folder}/{schema}", name)
        self.catalog.schemas[schema][name] = Graph(name, stored.vertices, stored.edges, g.closed, g.version, g.indexes)
        saved = json.loads(read_text(self.spark, self._file)) if exists(self.spark, self._file) else {}
        saved[schema] = sorted({*saved.get(schema, []), name})
        write_text(self.spark, self._file, json.dumps(saved))
        return self.catalog.schemas[schema][name]

    def drop(self, name: str, schema: str = "default") -> None:
        if self.catalog.graphs(schema).pop(name, None) is None:
            raise GraphFault(f"graph {name} doesn't exist")
        saved = json.loads(read_text(self.spark, self._file)) if exists(self.spark, self._file) else {}
        saved[schema] = [n for n in saved.get(schema, []) if n != name]
        write_text(self.spark, self._file, json.dumps(saved))

    def vacuum(self, schema: str = "default") -> int:
        """Deletes snapshots of versions other than the saved one; how many went."""
        from .sources.files import delete, listed

        gone = 0
        base = f"{self.folder}/{schema}"
        named = {json.loads(read_text(self.spark, f"{base}/{n}"))["manifest"].split("/")[-2] for n, folder in listed(self.spark, base) if n.endswith(".json") and not folder}
        for n, folder in listed(self.spark, base):
            if folder and n not in named:
                delete(self.spark, f"{base}/{n}")
                gone += 1
        return gone
