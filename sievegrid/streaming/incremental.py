"""Streams over event tables and incremental ingestion.

Timestamps without zone are cast, as watermarks need instants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files of ``folder`` as a stream with ``ts`` as an instant."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events and mean value per window and type; ``late`` sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events with gaps shorter than ``gap``."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def once_per_event(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str = "file_sha256", extend: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends rows with unseen keys to the Parquet folder ``target``, batch by batch until the input is used up. A batch that is repeated after a failure
    writes nothing twice, since what is already there is left out first."""
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        (extend(fresh) if extend else fresh).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
