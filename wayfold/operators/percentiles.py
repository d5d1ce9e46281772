"""Exact percentiles of groups that may each hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import Lookup, lookup_join

# Accuracy of the sketch (relative rank error 1 / ACCURACY) and the margin, in ranks relative to
# the group, taken on both sides of it: ten times that error.
ACCURACY = 10000
MARGIN = 0.001


def exact_percentiles(
    df: DataFrame, by: str, value: str, levels: dict[str, float]
) -> DataFrame:
    """``by`` and one column per level, interpolated linearly between neighbouring rows.

    A sketch per group brackets each wanted rank. Rows outside a bracket are only counted, with the
    values next to it kept, since in a small group the wanted row may stand right beside it; equal
    values inside it are combined before they are sorted. A group with a third of all rows then
    sorts about a five-hundredth of its values, and the result is exact. NULL and NaN are no values
    and do not count; a rank that no bracket holds is an error.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(
        F.col(by).alias("group"), number.alias("value")
    )
    edges = [
        min(1.0, max(0.0, q + side * MARGIN)) for q in levels.values() for side in (-1, 1)
    ]
    points = F.array(*[F.lit(e) for e in edges])
    sketch = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", points, ACCURACY).alias("at"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(q) * (F.col("n") - 1)).alias("target"),
                F.col("at")[2 * i].alias("low"),
                F.col("at")[2 * i + 1].alias("high"),
            )
            for i, (name, q) in enumerate(levels.items())
        ]
    )
    # One row per group. NULL is a group too, so the join key is a text that is never NULL.
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    wanted = Lookup.stage(
        sketch.select(key.alias("key"), brackets.alias("brackets")),
        ["key"],
        "percentile-brackets",
    )
    side = F.when(F.col("value") < F.col("b.low"), -1).when(F.col("value") > F.col("b.high"), 1)
    placed = (
        lookup_join(rows.withColumn("key", key), wanted, ["key"], "inner")
        .select("group", "value", F.explode("brackets").alias("b"))
        .withColumn("side", F.coalesce(side, F.lit(0)))
        .groupBy(
            "group",
            F.col("b.name").alias("name"),
            F.col("b.target").alias("target"),
            "side",
            F.when(F.col("side") == 0, F.col("value")).alias("inside"),
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("value").alias("bottom"),
            F.max("value").alias("top"),
        )
    )
    upward = Window.partitionBy("group", "name").orderBy("side", "inside")
    last = F.sum("rows").over(upward.rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("last", last).withColumn("first", F.col("last") - F.col("rows"))

    def value_at(rank: Column) -> Column:
        covers = (F.col("first") <= rank) & (rank < F.col("last"))
        held = (
            F.when((F.col("side") == 0) | (rank == F.col("last") - 1), F.col("top"))
            .when(rank == F.col("first"), F.col("bottom"))
            .otherwise(F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double"))
        )
        # Below the bracket the last value is next to it, above it the first.
        return F.max(F.when(covers, held))

    low, high = F.floor("target"), F.ceil("target")
    picked = ranked.groupBy("group", "name").agg(
        value_at(low).alias("a"),
        value_at(high).alias("b"),
        F.any_value(F.col("target") - F.floor("target")).alias("part"),
    )
    exact = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return picked.groupBy(F.col("group").alias(by)).agg(
        *[
            F.max(F.when(F.col("name") == name, exact)).alias(name) for name in levels
        ]
    )
