"""Staging tables, the versioned catalog and the request-log tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.names import INDEX_TABLES, NameIndex
from wayfold.plans.scratch import staged

RAW_TABLES = ("products_raw", "product_solo_sales_raw", "product_cooccurrence_raw")
FINAL_TABLES = ("products", "product_solo_sales", "product_cooccurrence")

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("query", T.StringType(), False),
        T.StructField("intent_type", T.StringType()),
        T.StructField("tools_called", T.ArrayType(T.StringType())),
        T.StructField("tool_arguments", T.MapType(T.StringType(), T.StringType())),
        T.StructField("used_fallback", T.BooleanType()),
        T.StructField("products_returned", T.IntegerType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("llm_tokens_used", T.IntegerType()),
        T.StructField("success", T.BooleanType()),
    ]
)
FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("rated_at", T.TimestampType(), False),
        T.StructField("rating", T.IntegerType()),
        T.StructField("product_id", T.LongType()),
    ]
)
# Columns a log has of its feedback.
FEEDBACK_COLUMNS = T.StructType(
    [
        T.StructField("user_feedback", T.IntegerType()),
        T.StructField("user_clicked_product", T.LongType()),
        T.StructField("rated_at", T.TimestampType()),
    ]
)
# Allowed ratings.
LOWEST_RATING, HIGHEST_RATING = 1, 5


def write_raw(tables: dict[str, DataFrame], root: str) -> None:
    """Replace staging tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def load_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in RAW_TABLES}


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database; pass the partition options for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_catalog(tables: dict[str, DataFrame], root: str) -> str:
    """Write the final tables as a new version and make it the current one.

    The tables of a name index may be among them. Spark has no transaction across tables. All tables of a version go to a new folder first;
    then a single one-row append names it, and only that makes it visible to readers.
    """
    missing = set(FINAL_TABLES) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    version = uuid.uuid4().hex
    for name in [*FINAL_TABLES, *(n for n in INDEX_TABLES if n in tables)]:
        tables[name].write.parquet(f"{root}/versions/{version}/{name}")
    spark = tables["products"].sparkSession
    spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    ).write.mode("append").parquet(f"{root}/published")
    return version


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version published last."""
    folder = _last_version(spark, root)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in FINAL_TABLES}


def read_name_index(spark: SparkSession, root: str) -> NameIndex:
    """The name index of the version published last."""
    folder = _last_version(spark, root)
    return NameIndex.over({name: spark.read.parquet(f"{folder}/{name}") for name in INDEX_TABLES})


def _last_version(spark: SparkSession, root: str) -> str:
    published = spark.read.parquet(f"{root}/published")
    version = published.agg(F.max_by("version", "published_at").alias("v")).first()["v"]
    return f"{root}/versions/{version}"


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows, one folder per day so that time filters skip the others."""
    _by_day(logs).write.mode("append").partitionBy("day").parquet(path)


def append_log_stream(logs: DataFrame, path: str, checkpoint: str):
    """As :func:`append_logs` for a stream; returns the started query."""
    return (
        _by_day(logs)
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_logs_once(
    logs: DataFrame, path: str, checkpoint: str, id_col: str = "log_id", watermark: str = "1 day"
):
    """As :func:`append_log_stream`, each log once: returns the started query.

    Repeats of a log id within the watermark are removed by the stream's state. A batch is written to a folder of
    its number and replaces what an attempt that broke off has left there, so a restart writes nothing
    twice. Read by day; the folders of the batches are a partition column of no further meaning.
    """
    timed = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    once = timed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([id_col])

    return (
        once.writeStream.foreachBatch(lambda batch, number: _write_batch(batch, path, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_batch(batch: DataFrame, path: str, number: int) -> None:
    _by_day(batch).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")


def merge_feedback(spark: SparkSession, logs_path: str, feedback: DataFrame) -> list:
    """Put accepted feedback into the logs stored by day; returns the days that were rewritten.

    A log takes the last rating of its time and session, and with it ``user_feedback, user_clicked_product`` and
    ``rated_at``, when that is later than what it has. So the same feedback again changes nothing, in any
    order, and only days with a log that changes are written. The new rows are stored in the scratch folder
    before the days are replaced; a merge that breaks off is repeated with the same feedback.
    """
    logs = read_logs(spark, logs_path)
    key = ["timestamp", "session_id"]
    last = (
        feedback.where(rating_ok())
        .groupBy(*key)
        .agg(F.max(F.struct("rated_at", "rating", "product_id")).alias("new"))
    )
    last = Lookup.stage(last, key, "feedback-merge")
    # One row per day.
    days = [r["d"] for r in last.df.select(F.to_date("timestamp").alias("d")).distinct().collect()]
    have = F.struct("rated_at", F.col("user_feedback").alias("rating"), F.col("user_clicked_product").alias("product_id"))
    newer = F.col("new").isNotNull() & (F.col("rated_at").isNull() | (F.col("new") > have))
    met = lookup_join(logs.where(F.col("day").isin(days)), last, key)
    changed = [r["day"] for r in met.where(newer).select("day").distinct().orderBy("day").collect()]
    if not changed:
        return []
    fields = {"rated_at": "rated_at", "user_feedback": "rating", "user_clicked_product": "product_id"}
    rewritten = (
        lookup_join(logs.where(F.col("day").isin(changed)), last, key)
        .withColumns({c: F.when(newer, F.col(f"new.{n}")).otherwise(F.col(c)) for c, n in fields.items()})
        .drop("new")
    )
    (
        staged(rewritten.select(*logs.columns), "merged-feedback")
        .repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(logs_path)
    )
    return changed


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs stored by day with their feedback columns, which days without feedback lack."""
    found = spark.read.parquet(path).schema
    names = set(found.names)
    added = [f for f in FEEDBACK_COLUMNS.fields if f.name not in names]
    return spark.read.schema(T.StructType([*found.fields, *added])).parquet(path)


def _by_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn("day", F.to_date("timestamp"))


def rating_ok() -> Column:
    """The rating check; like a table constraint it lets an unknown rating pass."""
    inside = F.col("rating").between(LOWEST_RATING, HIGHEST_RATING)
    return F.coalesce(inside, F.lit(True))


def validate_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split feedback into accepted and rejected rows."""
    return feedback.where(rating_ok()), feedback.where(~rating_ok())
