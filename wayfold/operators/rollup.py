"""Hourly partial aggregates of the request logs, kept beside them and refreshed by day.

A row holds what can be added up over hours: counts, sums, a sketch of the latencies and one of the sessions. Answers
over any longer time come from these rows and never read the logs. Logs and rollup are stored by day; a refresh
compares the numbers of log rows, which needs no row of the logs, and rewrites only the days that differ.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.querylog import BUDGET_ALERT_SHARE, MAX_TOKENS_PER_QUERY, MONTHLY_BUDGET_USD

# Size of the latency sketch and the share of the rows by which a rank may be off. The sketch is right
# within a third of it for 99 of 100 ranks; groups of no more rows than its size are exact.
SKETCH = 800
RANK_ERROR = 0.01
KEYS = ("day", "hour", "intent_type")


def rollup(logs: DataFrame, token_cap: int = MAX_TOKENS_PER_QUERY) -> DataFrame:
    """One row for each hour and intent of logs that carry their ``day``.

    NULL latencies, results and tokens do not count, as in averages over the logs; a NULL success or
    fallback counts as false. NULL sessions are no session.
    """
    latency = F.col("response_time_ms")
    return logs.groupBy("day", F.date_trunc("hour", "timestamp").alias("hour"), "intent_type").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("success").alias("successes"),
        F.count_if("used_fallback").alias("fallbacks"),
        F.count(latency).alias("timed"),
        F.sum(latency).alias("latency"),
        F.count("products_returned").alias("answered"),
        F.sum("products_returned").alias("results"),
        F.sum("llm_tokens_used").alias("tokens"),
        F.count_if(F.col("llm_tokens_used") > token_cap).alias("over_cap"),
        F.kll_sketch_agg_double(latency, F.lit(SKETCH)).alias("latencies"),
        F.hll_sketch_agg("session_id").alias("sessions"),
    )


def refresh_rollup(
    spark: SparkSession, logs_path: str, rollup_path: str, token_cap: int = MAX_TOKENS_PER_QUERY
) -> list:
    """Bring the stored rollup up to the logs stored by day; returns the days that were rewritten.

    Only these days of the logs are read. A refresh that is broken off leaves whole days, old or new, and the next one
    finishes the rest. Days are compared by their number of rows, so logs may be added but not changed in place.
    """
    logs = spark.read.parquet(logs_path)
    now = logs.groupBy("day").agg(F.count(F.lit(1)).alias("now"))
    try:
        stored = spark.read.parquet(rollup_path)
        before = stored.groupBy("day").agg(F.sum("queries").alias("before"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        before = now.select("day", F.lit(0).cast("long").alias("before")).limit(0)
    differing = now.join(before, "day", "left").where(~F.col("now").eqNullSafe(F.col("before")))
    # One row per day.
    days = [row["day"] for row in differing.select("day").orderBy("day").collect()]
    if days:
        (
            rollup(logs.where(F.col("day").isin(days)), token_cap)
            .repartition("day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(rollup_path)
        )
    return days


def _mean(total: str, count: str) -> Column:
    return F.sum(total) / F.nullif(F.sum(count), F.lit(0)).cast("double")


def _rate(count: str) -> Column:
    return F.sum(count) / F.nullif(F.sum("queries"), F.lit(0)).cast("double")


def stats(rows: DataFrame) -> DataFrame:
    """As :func:`wayfold.operators.querylog.log_stats`, from the rollup."""
    return rows.agg(
        F.coalesce(F.sum("queries"), F.lit(0)).alias("total_queries"),
        _rate("successes").alias("success_rate"),
        _mean("latency", "timed").alias("avg_response_time_ms"),
        _mean("results", "answered").alias("avg_products_returned"),
        _rate("fallbacks").alias("fallback_rate"),
    )


def performance(rows: DataFrame, by: Column | str = "intent_type") -> DataFrame:
    """As :func:`wayfold.operators.querylog.performance_by`, from the rollup, with sessions.

    ``by`` is made of the rollup's keys. ``sessions`` is the estimate of the merged sketches.
    """
    return rows.groupBy(by).agg(
        F.sum("queries").alias("queries"),
        _mean("latency", "timed").alias("avg_latency"),
        _mean("results", "answered").alias("avg_results"),
        _rate("successes").alias("success_rate"),
        F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"),
    )


def budget(
    rows: DataFrame, usd_per_1000_tokens: float, budget_usd: float = MONTHLY_BUDGET_USD
) -> DataFrame:
    """As :func:`wayfold.operators.querylog.budget_flags`, from the rollup and its token cap."""
    return (
        rows.groupBy(F.date_format("hour", "yyyy-MM").alias("month"))
        .agg(
            F.sum("queries").alias("queries"),
            F.sum("tokens").alias("tokens"),
            F.sum("over_cap").alias("over_cap"),
        )
        .withColumn("cost_usd", F.col("tokens") * usd_per_1000_tokens / 1000)
        .withColumn("alert", F.col("cost_usd") > budget_usd * BUDGET_ALERT_SHARE)
    )


def percentiles(rows: DataFrame, levels: dict[str, float], by: Column | str = "intent_type") -> DataFrame:
    """Latency percentiles from the merged sketches; a rank is off by ``RANK_ERROR`` of the rows at most."""
    merged = rows.groupBy(by).agg(F.kll_merge_agg_double("latencies").alias("sketch"))
    known = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select(
        by,
        *[
            F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name)
            for name, q in levels.items()
        ],
    )
