"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row for each distinct text ever admitted.  New data is reduced
to one row a digest (a partial aggregate, so a text that fills a third of the table shuffles as one row a task), then
sort-merge anti-joined with the index, and what is new is appended.  DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CREATED, documents, materialise, numbered_columns, partitions

#: A digest is hot with this many rows, if they are one in HOT_SHARE of all; so at most HOT_SHARE digests are hot.
HOT_ROWS, HOT_SHARE = 1000, 1000


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of each text in UTF-8; null counts as empty."""
    return documents(docs).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A digest index kept under a name in the session's warehouse, or at a path of its own.

    Batches are admitted one after another, and what the index has stays: keep_id is the largest doc_id of a text within the
    batch that brought it first, group_size its rows there; later copies are told by the index and add nothing to it.  Null
    doc_ids are passed over unless a text has no other, then keep_id is null.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None) -> None:
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            where = f" LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets or partitions(spark)} BUCKETS{where}")

    @staticmethod
    def groups(docs: DataFrame) -> DataFrame:
        return digests(docs).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The index read without its buckets, for joins on more than the digest."""
        self.spark.sql(f"REFRESH TABLE {self.name}")
        place = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").first()["data_type"]
        return self.spark.read.schema(self.table().schema).parquet(place)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't have; a sort-merge join that reads the index bucket by bucket."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def admit(self, docs: DataFrame) -> None:
        """Appends the texts that are new.  A batch that was admitted before adds nothing."""
        # written first: else the optimizer moves the anti-join below the aggregate, where copies haven't been merged yet
        fresh = self.fresh(materialise(self.groups(docs), "digest-groups"))
        buckets = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()["data_type"]
        fresh.write.mode("append").bucketBy(int(buckets), "digest").sortBy("digest").format("parquet").saveAsTable(self.name)

    def looked_up(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows (with a digest column `key`) beside keep_id and group_size.

        Digests with a thousandth of all rows or more are looked up by broadcast: there are a thousand of them at most,
        whatever the table's size.  The others meet the index in a sort-merge join, where no key is hot any more.
        """
        self.spark.sql(f"REFRESH TABLE {self.name}")
        index = self.table()
        least = max(HOT_ROWS, (index.agg(F.sum("group_size").alias("n")).first()["n"] or 0) / HOT_SHARE)
        hot = F.col("group_size") >= least
        renamed = index.withColumnRenamed("digest", "_digest")
        often = rows.join(F.broadcast(renamed.where(hot)), F.col(key) == F.col("_digest"))
        others = rows.join(F.broadcast(renamed.where(hot).select("_digest")), F.col(key) == F.col("_digest"), "left_anti")
        seldom = others.join(renamed.where(~hot).hint("merge"), F.col(key) == F.col("_digest"))
        return often.unionByName(seldom).drop("_digest")

    def resolve(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

        Of rows that repeat the kept doc_id with the same text, all are kept.
        """
        return self.looked_up(digests(docs), "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def own_name() -> str:
    """A name for an index of one use."""
    CREATED.append(("table", f"digest_index_{uuid.uuid4().hex}"))
    return CREATED[-1][1]


def exact_dedup(docs: DataFrame, index: str | None = None) -> DataFrame:
    """Admits the documents to a (new) index and gives each its class.  Empty table: no rows."""
    spark = docs.sparkSession
    store = DigestIndex(spark, index or own_name())
    store.admit(docs)
    return store.resolve(docs)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, with all their columns, whatever their names.

    Of equal texts the row with the largest doc_id stays; rows that repeat both doc_id and text count as one row, and
    any one of them stays.  Null texts are empty ones; a text that only rows without a doc_id have keeps one of them.
    """
    spark = docs.sparkSession
    store = DigestIndex(spark, own_name())
    store.admit(docs)
    rows, at = numbered_columns(docs)
    keyed = rows.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col(at["text"]).cast("string"), F.lit("")).cast("binary"), 256))).withColumn("_id", F.col(at["doc_id"]).cast("long"))
    kept = store.plain().select(F.col("digest").alias("_kept_digest"), F.col("keep_id").alias("_kept_id"))
    # both sides are dealt by digest and doc_id together, so no text is hot, and one exchange serves join and repeats
    found = keyed.join(kept.hint("merge"), (F.col("_digest") == F.col("_kept_digest")) & F.col("_id").eqNullSafe(F.col("_kept_id")))
    return found.dropDuplicates(["_digest", "_id"]).select(*rows.columns).toDF(*docs.columns)
