"""Intermediate tables which cut lineage and outlive the executors that wrote them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session.

    Only a local session without the setting gets a folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would not be seen by the executors.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="wayfold-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/wayfold-{app}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Unlike a cached frame the result survives lost executors, is pruned by column, and carries
    its true size into later join planning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: text by its length, nested values by their JSON text, the rest as 8."""
    size = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = F.octet_length(F.to_json(F.struct(column)))
        else:
            width = F.lit(8)
        size = size + width
    return size.cast("long")


def staged_and_measured(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """As :func:`staged`, with the rows and their total size, both taken while writing."""
    seen = Observation()
    total = F.coalesce(F.sum(row_bytes(df)), F.lit(0))
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), total.alias("bytes"))
    table = staged(watched, label)
    return table, seen.get["rows"], seen.get["bytes"]
