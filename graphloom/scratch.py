"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.files import delete


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset, a session on one machine takes a folder in its warehouse;
    a cluster has to name one, as no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: What this process has written, in order.
CREATED: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the tables written so far; results that read from them must be written before."""
    while CREATED:
        delete(spark, CREATED.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the frame as a Parquet table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    CREATED.append(path)
    return spark.read.schema(df.schema).parquet(path)
