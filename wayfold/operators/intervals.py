"""Interval labels of a tree, and lowest common ancestors by range minimum.

Places are numbered in preorder; a place's interval ends where its subtree does, so one place contains
another when its interval contains the other's number. Of two places apart, every place numbered after the first
up to the second that has the least depth is a child of their lowest common ancestor. A table of
minima over ranges of power-of-two lengths answers that with two entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.places import shared_level

# A table entry is the depth, moved left by so many bits, plus the deepest level above, moved to start at 0.
_LEVEL_BITS = 32
_LEVEL_SHIFT = 1 << 31
_LEVEL_MASK = (1 << _LEVEL_BITS) - 1


def preorder(hierarchy: DataFrame) -> DataFrame:
    """One row: ``places``, an array of ``id``, ``depth`` and ``above`` in preorder.

    ``above`` is the highest level among the proper ancestors, null for a root. Siblings follow their
    positions and, if those are equal, their ids; trees of several countries follow each other.
    """
    ids = F.reverse(F.transform("ancestors", lambda a: a["id"]))
    steps = F.zip_with("path", ids, lambda position, id_: F.struct(position.alias("p"), id_.alias("i")))
    country = [F.col("country")] if "country" in hierarchy.columns else []
    above = F.array_max(F.transform(F.slice("ancestors", F.lit(2), F.size("ancestors")), lambda a: a["level"]))
    entry = F.struct(
        *country, steps.alias("steps"), F.col("id").alias("id"), F.size("path").alias("depth"), above.alias("above")
    )
    ordered = F.sort_array(F.collect_list(entry))
    kept = F.transform(
        ordered, lambda e: F.struct(e["id"].alias("id"), e["depth"].alias("depth"), e["above"].alias("above"))
    )
    return hierarchy.agg(kept.alias("places"))


def with_intervals(hierarchy: DataFrame) -> DataFrame:
    """The hierarchy with ``enter`` and ``leave``: a place's number and that of the first place after its subtree."""
    numbers = preorder(hierarchy).select(F.posexplode("places").alias("enter", "p"))
    sizes = (
        hierarchy.select(F.explode(F.transform("ancestors", lambda a: a["id"])).alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    labels = numbers.select(F.col("p.id").alias("id"), "enter").join(sizes, "id")
    labels = labels.withColumn("leave", (F.col("enter") + F.col("size")).cast("int")).drop("size")
    return hierarchy.join(labels, "id")


def range_minima(hierarchy: DataFrame, places: int) -> DataFrame:
    """One row: ``ranges``, a struct of ``minima`` by power of two and start, and ``logs`` of lengths.

    ``places`` is the number of rows. The table has that number times its logarithm entries.
    """
    packed = F.transform(
        "places",
        lambda p: F.shiftleft(p["depth"].cast("long"), _LEVEL_BITS)
        + F.coalesce(p["above"].cast("long"), F.lit(-_LEVEL_SHIFT))
        + _LEVEL_SHIFT,
    )

    def longer(known: Column, power: Column) -> Column:
        last = F.element_at(known, -1)
        half = _power_of_two(power - 1)
        starts = F.sequence(F.lit(0), F.size(last) - half - 1)
        return F.concat(
            known, F.array(F.transform(starts, lambda i: F.least(F.get(last, i), F.get(last, i + half))))
        )

    powers = places.bit_length() - 1
    minima = F.array(F.col("packed"))
    if powers > 0:
        minima = F.aggregate(F.sequence(F.lit(1), F.lit(powers)), minima, longer)
    logs = F.transform(F.sequence(F.lit(1), F.lit(max(places, 1))), lambda n: F.length(F.bin(n)) - 1)
    return preorder(hierarchy).select(packed.alias("packed")).select(
        F.struct(minima.alias("minima"), logs.alias("logs")).alias("ranges")
    )


def contains(outer: Column, inner: Column) -> Column:
    """Whether a labelled place is the other or lies above it."""
    return inner["enter"].between(outer["enter"], outer["leave"] - 1)


def with_shared_level(
    df: DataFrame, left: str, right: str, ranges: DataFrame, result: str
) -> DataFrame:
    """Add the level that two columns of labelled places share, see :func:`wayfold.functions.places.shared_level`.

    Each step is a column of its own, so that the table of minima is fetched once and nothing is
    worked out twice.
    """
    one, two = F.col(left), F.col(right)
    first, length, power = F.col("_wf_first"), F.col("_wf_length"), F.col("_wf_power")
    row, least = F.col("_wf_row"), F.col("_wf_least")
    level = least.bitwiseAND(F.lit(_LEVEL_MASK)) - _LEVEL_SHIFT
    deepest = F.when(level > -_LEVEL_SHIFT, level.cast("int"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return (
        df.withColumn("_wf_ranges", ranges.scalar())
        .withColumn("_wf_first", F.least(one["enter"], two["enter"]) + 1)
        .withColumn("_wf_length", F.greatest(one["enter"], two["enter"]) - first + 1)
        .withColumn("_wf_power", F.get("_wf_ranges.logs", length - 1))
        .withColumn("_wf_row", F.get("_wf_ranges.minima", power))
        .withColumn(
            "_wf_least", F.least(F.get(row, first), F.get(row, first + length - _power_of_two(power)))
        )
        .select(
            *kept, shared_level(one, two, contains(one, two), contains(two, one), deepest).alias(result)
        )
    )


def _power_of_two(power: Column) -> Column:
    return F.get(F.lit([1 << k for k in range(31)]), power)
