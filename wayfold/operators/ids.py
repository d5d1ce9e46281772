"""Dense ids in a given order, without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import row_hash
from wayfold.plans.scratch import staged

# monotonically_increasing_id keeps the partition in its upper and the row in its lower 33 bits.
_ROW_BITS = 33


def assign_ids(
    df: DataFrame, order: list[Column], id_col: str = "id", start: int = 1
) -> DataFrame:
    """Number the rows ``start..`` in ``order``; the id becomes the first column.

    The table is range-partitioned by the order, each partition numbers its own rows, and the
    row counts of the partitions give the offsets. A content hash and then the stored row number
    are the last order keys, so that neither a very common value nor many copies of one row end up
    in a single range.
    """
    stored = staged(df.withColumn("_copy", F.monotonically_increasing_id()), "unnumbered")
    keys = [*order, row_hash(df).asc(), F.col("_copy").asc()]
    numbered = staged(
        stored.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_copy")
        .withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("_slot", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow - 1
    )
    # One row per partition of the table above.
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_offset") + row + start).alias(id_col), *df.columns)
    )
