"""Reading and writing small text files (manifests, queries) through Hadoop's file systems, so that any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames, so that a reader sees the old or the new text."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    fs.rename(part, p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a directory) of what a folder holds, sorted."""
    fs, p = _fs(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
