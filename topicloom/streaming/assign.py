"""Topics for streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.accessors import predict


def assign_stream(stream: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """doc_id, topic, probability of a streaming DataFrame: a join with one static row, without state."""
    return predict(stream, centroids, vector)


def topic_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, topic, n) for event-time windows of rows that have ``time`` and ``topic``."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(span.alias("w"), "topic").agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", "topic", "n")
