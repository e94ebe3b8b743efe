"""Streaming forms of the counts that grow with each import or feedback. Windows and late data are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.taxonomy import upsert


def seen_counts(rows: DataFrame) -> DataFrame:
    """Counts by (user_id, raw_title, raw_author); the same plan for a stream in update mode and for a batch."""
    return rows.groupBy("user_id", "raw_title", "raw_author").agg(F.count("*").alias("seen_count"))


def windowed_feedback(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Feedback by window and type, with a watermark; events: (ts timestamp, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def merge_counts(current: DataFrame, batch: DataFrame, key: str, count: str) -> DataFrame:
    """For foreachBatch: counts of a micro-batch added to those that stand."""
    added = batch.join(current.select(F.col(key).alias("_k"), F.col(count).alias("_n")), F.col(key) == F.col("_k"), "left").select(key, (F.col(count) + F.coalesce("_n", F.lit(0))).alias(count))
    return upsert(current, added, key)
