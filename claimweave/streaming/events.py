"""Streams of events: windows with late data, sessions, and claims that arrive over time.

The same plan functions serve batch and stream. Watermarks bound the state; rows later than the watermark are dropped by a
stream and kept by a batch. Null timestamps are in no window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of `value` per window and keys."""
    e = events.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    if late:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of activity per keys: runs of events with gaps below `gap`."""
    e = events.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    if late:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Events once per key within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def relink_stream(claims: DataFrame, link: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Claims as they arrive: each batch is appended to the stored claims, and the edges of the keys it touches are linked
    anew from all stored claims of these keys. Edges are written per batch id, so a batch that runs twice replaces itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/claims/batch={batch_id}")
        stored = spark.read.parquet(f"{folder}/claims")
        touched = stored.where(F.col("batch") == batch_id).select("key").distinct()
        link(stored.where(F.col("batch") <= batch_id).join(touched, "key", "left_semi")).write.mode("overwrite").parquet(f"{folder}/edges/batch={batch_id}")

    return claims.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(edges: DataFrame, key: str = "claim_key") -> DataFrame:
    """Edges of the last batch that linked each key."""
    last = edges.groupBy(key).agg(F.max("batch").alias("batch"))
    return edges.join(last, [key, "batch"], "left_semi").drop("batch")
