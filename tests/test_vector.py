"""Vector search for many queries against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import VID
from graphloom.operators import vector
from graphloom.queries import QUERIES


@pytest.mark.parametrize("block", [32 << 20, 2 * 8 * 64])
def test_recall_at_10(spark, data, monkeypatch, block):
    monkeypatch.setattr(vector, "QUERY_BYTES", block)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["vector_approximate"](spark, data).collect():
        got.setdefault(r["qid"], {})[r["vid"]] = r["distance"]
    asked = ids[ids % 100 == 0]
    assert sorted(got) == sorted(asked.tolist()) and all(len(x) == 10 for x in got.values())
    hits = 0
    for q in asked.tolist():
        d = ((v - v[ids == q]) ** 2).sum(axis=1)
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(best.tolist()) & set(got[q]))
        assert all(abs(got[q][i] - d[ids == i][0]) < 1e-9 for i in got[q])
    assert hits / (10 * len(asked)) >= 0.9


def test_ties_short_tables_and_nulls(spark):
    rows = [(i, [1.0, 2.0] if i % 2 else [float(i), 0.0]) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, f"{VID} long, v array<float>").repartition(3)
    asked = df.where(F.col(VID).isin(1, 60)).select(F.col(VID).alias("qid"), "v")
    got = [(r["qid"], r["vid"], r["distance"]) for r in vector.nearest_approximate(df, "v", asked, 4, 2).collect()]
    assert sorted(got) == [(1, 1, 0.0), (1, 3, 0.0), (1, 5, 0.0), (1, 7, 0.0)]
    assert vector.nearest_approximate(df.limit(0), "v", asked, 4, 2).collect() == []
    assert vector.nearest_approximate(df, "v", asked.limit(0), 4, 2).collect() == []
    assert vector.nearest_approximate(df.where(f"{VID} < 3"), "v", asked, 4, 2).count() == 3
