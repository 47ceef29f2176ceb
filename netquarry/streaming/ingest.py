"""Incremental ingest: label files that land in a folder become an upserted Parquet table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spef import nets, read_spef
from ..sources.text import named


def landing(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Streaming rows (path, window_id, text) of new files in a folder."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return named(stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def ingest_totals(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Net totals of all files that landed so far, written as one Parquet folder a batch; reruns skip what is done.

    A batch that runs again after a failure overwrites its own folder, so that nothing counts twice.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        nets(read_spef(batch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    query = landing(spark, source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_totals(spark: SparkSession, target: str) -> DataFrame:
    """Per window and net the total of the latest batch, and in it of the last declaration."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy("window_id", "net").agg(F.max_by("total_f", F.struct("epoch", "seq")).alias("total_f"))
