"""Streaming forms: claims answered as they arrive, and latency by time window. An addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import BM25


def windowed_latency(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of ``value`` by event type and event-time window; rows later than ``late`` are not waited for."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean")
    )


def answer_claims(claims: DataFrame, index: BM25, path: str, *, k: int = 5, checkpoint: str) -> StreamingQuery:
    """Write the k best documents of each arriving claim; each batch is written under its own number, so a retry replaces it."""

    def batch(rows: DataFrame, number: int) -> None:
        index.search(rows, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
