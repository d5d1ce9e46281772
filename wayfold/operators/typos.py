"""Names within a few edits of known ones, met by the parts that edits must leave alone.

A known name is cut into one part more than edits are allowed. Edits cannot touch all of the parts, so one of them stands
in the other name unchanged, moved by no more than the number of edits. Parts meet by equality, and only names
that share one are compared. The rows follow the number of edits, not the length of the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.joins import Lookup, lookup_join


def near_names(
    asked: DataFrame, known: DataFrame, max_distance: int, scope: list[str] | None = None
) -> DataFrame:
    """``name, candidate, distance`` of every distinct asked ``name`` and every known one within the edit distance.

    Names meet within equal ``scope`` columns only. Null names meet nothing.
    """
    scope = scope or []
    keys = [*scope, "size", "number", "part"]
    sizes = F.char_length("name")
    number = F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("number")
    named = known.where(F.col("name").isNotNull()).select(*scope, "name").distinct()
    parts = named.select(*scope, F.col("name").alias("candidate"), sizes.alias("size"), number)
    start, length = _part(F.col("size"), F.col("number"), max_distance)
    parts = parts.select(
        *scope, "candidate", "size", "number", F.substr("candidate", start + 1, length).alias("part")
    )
    lookup = Lookup.stage(parts, keys, "name-parts")
    lengths = F.sequence(F.greatest(F.lit(0), sizes - max_distance), sizes + max_distance)
    probes = (
        asked.where(F.col("name").isNotNull())
        .select(*scope, "name")
        .distinct()
        .select(*scope, "name", F.explode(lengths).alias("size"))
        .select(*scope, "name", "size", number)
        .withColumn("shift", F.explode(F.sequence(F.lit(-max_distance), F.lit(max_distance))))
        .withColumns({"start": start + F.col("shift"), "length": length})
        .where("start >= 0 and start + length <= char_length(name)")
        .select(*scope, "name", "size", "number", F.substr("name", F.col("start") + 1, "length").alias("part"))
        .distinct()
    )
    met = lookup_join(probes, lookup, keys, "inner").select(*scope, "name", "candidate").distinct()
    distance = F.levenshtein("name", "candidate", max_distance)
    return met.withColumn("distance", distance).where("distance >= 0")


def _part(size: Column, number: Column, max_distance: int) -> tuple[Column, Column]:
    """Start and length of one of the nearly equal parts of a name; the last ones are one longer."""
    parts = max_distance + 1
    shorter = parts - F.pmod(size, F.lit(parts))
    length = F.floor(size / parts).cast("int")
    start = number * length + F.greatest(F.lit(0), number - shorter)
    return start.cast("int"), (length + (number >= shorter).cast("int")).cast("int")


def nearest_names(
    asked: DataFrame, known: DataFrame, max_distance: int, scope: list[str] | None = None
) -> DataFrame:
    """For each distinct asked ``name`` the ``nearest`` known one, the alphabetically first of equals."""
    scope = scope or []
    return (
        near_names(asked, known, max_distance, scope)
        .groupBy(*scope, "name")
        .agg(F.min_by("candidate", F.struct("distance", "candidate")).alias("nearest"))
    )
