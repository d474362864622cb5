"""Trace events: tolerant JSON, stage timings, latest data, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(events: DataFrame, schema: str = "k long") -> DataFrame:
    """Events with the fields of ``props``; blank and malformed JSON rows are skipped."""
    j = F.from_json("props", schema)
    return events.withColumn("p", j).where("p is not null and trim(props) <> ''").select("event_id", "ts", "user_id", "event_type", "value", "p.*")


def latest_stage(events: DataFrame) -> DataFrame:
    """The data of the last event of every trace and stage; of events at the same time the greatest id."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def stage_timings(events: DataFrame) -> DataFrame:
    """Per stage: runs, total, mean, median and 95th percentile of the elapsed time, exact with linear interpolation."""
    return events.groupBy("event_type").agg(
        F.count("value").alias("n"), F.sum("value").alias("total_ms"), F.avg("value").alias("mean_ms"),
        F.expr("percentile(value, 0.5)").alias("median_ms"), F.expr("percentile(value, 0.95)").alias("p95_ms"),
    )


def recent_traces(events: DataFrame, limit: int = 100) -> DataFrame:
    """The traces that started last: ``(user_id, started_at, finished_at, n_stages)``."""
    t = events.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("n_stages"))
    return t.orderBy(F.desc("started_at"), "user_id").limit(limit)


def search(events: DataFrame, needle: str) -> DataFrame:
    """Events whose data or stage holds the text, whatever its case."""
    return events.where(F.lower("props").contains(needle.lower()) | F.lower("event_type").contains(needle.lower()))
