"""Degree statistics kept up to date from a stream of edge changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import VID
from ..sources.files import exists, read_text, write_text


class DegreeTable:
    """Versions of (_vid, degree) in a folder; a pointer file names the current one, and the batch it has taken in."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _pointer(self) -> tuple[str, int]:
        if not exists(self.spark, f"{self.folder}/current"):
            return "", -1
        path, batch = read_text(self.spark, f"{self.folder}/current").split("\n")
        return path, int(batch)

    def read(self) -> DataFrame:
        path, _ = self._pointer()
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], f"{VID} long, degree long")

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Adds a batch of (_vid, delta).  A batch that comes again is passed over, so replays are harmless."""
        _, last = self._pointer()
        if batch <= last:
            return
        new = self.read().unionByName(changes.select(VID, F.col("delta").cast("long").alias("degree"))).groupBy(VID).agg(F.sum("degree").alias("degree")).where("degree > 0")
        path = f"{self.folder}/v{batch}"
        new.write.mode("overwrite").parquet(path)
        write_text(self.spark, f"{self.folder}/current", f"{path}\n{batch}")


def maintain(changes: DataFrame, table: DegreeTable, checkpoint: str, end: str = "_src") -> StreamingQuery:
    """Starts a query over a stream of edge changes (_src, _dst, delta of +1 or -1) that keeps the degrees at one end."""

    def batch(df: DataFrame, number: int) -> None:
        table.merge(df.groupBy(F.col(end).alias(VID)).agg(F.sum("delta").alias("delta")), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, with a watermark; for streams and tables alike."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
