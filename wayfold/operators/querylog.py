"""Aggregates over request logs (columns as in ``wayfold.sources.tables.LOG_SCHEMA``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.catalog import share_of_total
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.percentiles import exact_percentiles
from wayfold.sources.tables import rating_ok

# Limits and thresholds of the log checks.
MAX_QUERY_CHARS = 500
FORBIDDEN_WORDS = ("DROP", "DELETE", "UPDATE", "ALTER", "EXEC")
MONTHLY_BUDGET_USD = 500
BUDGET_ALERT_SHARE = 0.8
MAX_TOKENS_PER_QUERY = 4000
OPPORTUNITY_SHARE = 0.05
RATE_LIMITS = (("free", 10, 100), ("premium", 60, 1000))


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def log_stats(logs: DataFrame) -> DataFrame:
    """One row of totals and rates; the rates are NULL when there are no logs."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_queries"),
        rate(F.coalesce("success", F.lit(False))).alias("success_rate"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.avg("products_returned").alias("avg_products_returned"),
        rate(F.coalesce("used_fallback", F.lit(False))).alias("fallback_rate"),
    )


def tool_usage(logs: DataFrame) -> DataFrame:
    """Calls per tool, most used first."""
    tools = logs.select(F.explode("tools_called").alias("tool"))
    return (
        tools.groupBy("tool")
        .agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.col("calls").desc(), "tool")
    )


def performance_by(logs: DataFrame, by: str) -> DataFrame:
    """Latency, results and success per value of a column."""
    # Names of the result columns.
    return logs.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("response_time_ms").alias("avg_latency"),
        F.avg("products_returned").alias("avg_results"),
        F.avg(F.when(F.col("success"), 1).otherwise(0)).alias("success_rate"),
    )


def fallback_queries(logs: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent texts that needed the fallback."""
    return (
        logs.where(F.col("used_fallback"))
        .groupBy("query")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.col("frequency").desc(), "query")
        .limit(limit)
    )


def failed_queries(logs: DataFrame, limit: int = 20) -> DataFrame:
    """Texts that fail most often."""
    return (
        logs.where(~F.col("success"))
        .groupBy("query")
        .agg(F.count(F.lit(1)).alias("failures"))
        .orderBy(F.col("failures").desc(), "query")
        .limit(limit)
    )


def latency_percentiles(logs: DataFrame, by: str = "intent_type") -> DataFrame:
    """Exact P50, P95 and P99 of the response time."""
    levels = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    return exact_percentiles(logs, by, "response_time_ms", levels)


def intent_distribution(logs: DataFrame) -> DataFrame:
    """Queries per intent with their share, from one scan."""
    return share_of_total(logs, F.col("intent_type"), "queries")


def tool_opportunities(
    logs: DataFrame, pattern: Column, share: float = OPPORTUNITY_SHARE
) -> DataFrame:
    """Patterns that reach the fallback in at least ``share`` of all queries."""
    found = share_of_total(logs, pattern.alias("pattern"), "queries", F.col("used_fallback"))
    return found.where(F.col("share") >= share)


def budget_flags(
    logs: DataFrame,
    usd_per_1000_tokens: float,
    budget: float = MONTHLY_BUDGET_USD,
    token_cap: int = MAX_TOKENS_PER_QUERY,
) -> DataFrame:
    """Tokens and cost per month, queries over the token cap, and the budget alert."""
    return (
        logs.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.sum("llm_tokens_used").alias("tokens"),
            F.count_if(F.col("llm_tokens_used") > token_cap).alias("over_cap"),
        )
        .withColumn("cost_usd", F.col("tokens") * usd_per_1000_tokens / 1000)
        .withColumn("alert", F.col("cost_usd") > budget * BUDGET_ALERT_SHARE)
    )


def rate_limit_breaches(
    logs: DataFrame, user: str, tiers: DataFrame | None = None, limits=RATE_LIMITS
) -> DataFrame:
    """Users whose calls in a minute or a day exceed their tier's limit.

    ``limits`` has (tier, per minute, per day); ``tiers`` maps ``user`` to ``tier``, users without
    one get the first. Calls are counted per user and minute once, days add up the minutes.
    """
    per_minute, per_day = F.lit(limits[0][1]), F.lit(limits[0][2])
    for tier, minute, day in limits[1:]:
        per_minute = F.when(F.col("tier") == tier, minute).otherwise(per_minute)
        per_day = F.when(F.col("tier") == tier, day).otherwise(per_day)
    minutes = logs.groupBy(
        user, F.date_trunc("minute", "timestamp").alias("start")
    ).agg(F.count(F.lit(1)).alias("calls"))
    days = minutes.groupBy(user, F.date_trunc("day", "start").alias("start")).agg(
        F.sum("calls").alias("calls")
    )
    periods = minutes.withColumn("period", F.lit("minute")).unionByName(
        days.withColumn("period", F.lit("day"))
    )
    if tiers is None:
        named = periods.withColumn("tier", F.lit(limits[0][0]))
    else:
        lookup = Lookup.over(tiers.select(user, "tier"), [user])
        named = lookup_join(periods, lookup, [user])
    limit = F.when(F.col("period") == "minute", per_minute).otherwise(per_day)
    return (
        named.withColumn("allowed", limit)
        .where(F.col("calls") > F.col("allowed"))
        .select(user, "period", "start", "calls", "allowed")
    )


def latest_logs(logs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest logs; those of one time by session, then by what else they hold."""
    ties = [c for c, kind in logs.dtypes if c != "timestamp" and not kind.startswith("map")]
    ties.sort(key=lambda c: c != "session_id")
    return logs.orderBy(F.col("timestamp").desc(), *ties).limit(limit)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last accepted rating per ``(timestamp, session_id)``, of equally late ones the highest."""
    return (
        feedback.where(rating_ok())
        .groupBy("timestamp", "session_id")
        .agg(F.max(F.struct("rated_at", "rating", "product_id")).alias("last"))
        .select(
            "timestamp",
            "session_id",
            F.col("last.rating").alias("user_feedback"),
            F.col("last.product_id").alias("user_clicked_product"),
        )
    )


def apply_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with their last accepted feedback; replaces an update in place."""
    key = ["timestamp", "session_id"]
    last = Lookup.stage(latest_feedback(feedback), key, "latest-feedback")
    return lookup_join(logs.drop("user_feedback", "user_clicked_product"), last, key)


def feedback_summary(rated: DataFrame, by: str) -> DataFrame:
    """Mean rating and number of ratings per value of a column."""
    return rated.groupBy(by).agg(
        F.count("user_feedback").alias("ratings"),
        F.avg("user_feedback").alias("mean_rating"),
    )


def tool_arguments(calls: DataFrame, log_key: str = "log_id") -> DataFrame:
    """Map of tool to arguments per log from ``tool, seq, args`` rows; a tool's last call wins."""
    last = calls.groupBy(log_key, "tool").agg(F.max_by("args", "seq").alias("args"))
    # One entry per different tool of a log.
    return last.groupBy(log_key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "args")))).alias(
            "tool_arguments"
        )
    )


def validate_requests(requests: DataFrame, text: str = "query") -> DataFrame:
    """Add ``rejected_for``: 'too long', 'suspicious' or NULL when the text is acceptable."""
    upper = F.upper(text)
    suspicious = F.lit(False)
    for word in FORBIDDEN_WORDS:
        suspicious = suspicious | F.contains(upper, F.lit(word))
    reason = F.when(F.char_length(text) > MAX_QUERY_CHARS, "too long").when(
        suspicious, "suspicious"
    )
    return requests.withColumn("rejected_for", reason)


def logs_to_json(logs: DataFrame) -> DataFrame:
    """Serialised form: ISO time stamps, lists and maps as JSON text."""
    seconds = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("timestamp", "SSSSSS")
    iso = F.when(micros == "000000", seconds).otherwise(
        F.concat(seconds, F.lit("."), micros)
    )
    return logs.withColumns(
        {
            "timestamp": iso,
            "tools_called": F.to_json("tools_called"),
            "tool_arguments": F.to_json("tool_arguments"),
        }
    )
