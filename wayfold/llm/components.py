"""Connected components of stored links, with native joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import discard, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links.

    Links are turned into stars by alternating two steps until each node has a single link, to a node without
    one: every node links its larger neighbours to its smallest, then its smaller ones. Both are a
    minimum per node and a join, so a node with very many links is aggregated before the shuffle and its
    rows can be split. Null ends and links of a node to itself do not count; a node may have any
    orderable type. Each round is stored in the shared scratch folder.
    """
    spark = links.sparkSession
    one, two = F.col(a), F.col(b)
    stars = stored(
        links.where(one != two)
        .select(F.greatest(one, two).alias("node"), F.least(one, two).alias("up"))
        .distinct(),
        "links",
    )
    while True:
        both = stars.select(F.col("node").alias("u"), F.col("up").alias("v")).union(
            stars.select(F.col("up").alias("u"), F.col("node").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # Larger neighbours, to the smallest.
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("node"), F.col("m").alias("up"))
            .distinct()
        )
        # Smaller neighbours, to the smallest.
        lowest = large.groupBy("node").agg(F.min("up").alias("m"))
        small = (
            large.join(lowest, "node")
            .where(F.col("up") != F.col("m"))
            .select(F.col("up").alias("node"), F.col("m").alias("up"))
            .union(lowest.select("node", F.col("m").alias("up")))
            .distinct()
        )
        following = stored(small, "stars")
        discard(spark, stars)
        stars = following
        # Stars: no node has two links, and none that is linked to has a link itself.
        tops = stars.select(F.col("up").alias("node"), F.lit(1).alias("top"))
        links_of = stars.select("node", F.lit(0).alias("top"))
        loose = (
            links_of.union(tops)
            .groupBy("node")
            .agg(F.sum(1 - F.col("top")).alias("links"), F.max("top").alias("top"))
            .where((F.col("links") > 1) | ((F.col("links") > 0) & (F.col("top") == 1)))
        )
        if loose.isEmpty():
            break
    roots = stars.select(F.col("up").alias("node")).distinct()
    return stars.select("node", F.col("up").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
