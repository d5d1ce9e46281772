"""Request logs and place pairs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.hierarchy import Gazetteer
from wayfold.operators.matching import match_levels
from wayfold.operators.rollup import SKETCH


def log_metrics(
    logs: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """Queries, success rate and mean latency per time window and intent.

    Works on a stream and, with the same result for rows in time, on a table. Rows later than the
    watermark are dropped by the stream. The state per window and intent is a few numbers.
    """
    timed = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("timestamp", watermark)
    return (
        timed.groupBy(F.window("timestamp", window).alias("w"), "intent_type")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.avg(F.coalesce("success", F.lit(False)).cast("int")).alias("success_rate"),
            F.avg("response_time_ms").alias("avg_latency"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "intent_type",
            "queries",
            "success_rate",
            "avg_latency",
        )
    )


def window_percentiles(
    logs: DataFrame,
    levels: dict[str, float],
    window: str = "5 minutes",
    watermark: str = "10 minutes",
) -> DataFrame:
    """Latency percentiles per time window and intent, from a mergeable sketch as the window's state.

    Works on a stream and on a table. A rank is off by :data:`wayfold.operators.rollup.RANK_ERROR` of the
    window's rows at most; windows of no more rows than the sketch's size are exact up to the choice between
    neighbours. ``timed`` counts the rows with a latency; without any the percentiles are NULL.
    """
    timed = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("timestamp", watermark)
    latency = F.col("response_time_ms")
    grouped = timed.groupBy(F.window("timestamp", window).alias("w"), "intent_type").agg(
        F.count(latency).alias("timed"),
        F.kll_sketch_agg_double(latency, F.lit(SKETCH)).alias("sketch"),
    )
    quantiles = [
        F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name)
        for name, q in levels.items()
    ]
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "intent_type",
        "timed",
        *quantiles,
    )


def match_stream(pairs: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Score a stream of place pairs; the lookups are static, so there is no state."""
    return match_levels(pairs, gaz)
