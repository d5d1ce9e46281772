"""Product table: defaults, ids and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.product import (
    age_bucket,
    family_friendly,
    franchise_clean,
    text_blob,
)
from wayfold.operators.ids import assign_ids

STORE_COLUMNS = ("store_a", "store_b", "store_c")
# Columns a raw product table is brought to.
PRODUCT_COLUMNS = {
    "name": "string",
    "segment": "string",
    "category": "string",
    "type": "string",
    "franchise": "string",
    "min_age": "int",
    "times_sold": "bigint",
    "store_a": "bigint",
    "store_b": "bigint",
    "store_c": "bigint",
    "release_date": "timestamp",
}


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add the missing columns as NULL."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    )


def fill_defaults(raw: DataFrame) -> DataFrame:
    """Missing store sales and ages are 0, missing totals the sum of the stores."""
    df = ensure_columns(raw, PRODUCT_COLUMNS)
    if dict(df.dtypes)["release_date"] == "string":
        df = df.withColumn("release_date", F.try_to_timestamp("release_date"))
    zero = {c: _whole(c, "bigint") for c in STORE_COLUMNS} | {
        "min_age": _whole("min_age", "int")
    }
    df = df.withColumns(zero)
    stores = F.col("store_a") + F.col("store_b") + F.col("store_c")
    total = F.coalesce(F.col("times_sold").cast("bigint"), stores)
    return df.withColumn("times_sold", total).withColumn(
        "release_date", F.col("release_date").cast("timestamp")
    )


def _whole(col: str, kind: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0)).cast(kind)


def popularity(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each ``target: source`` as a share of the source's maximum, 0.0 without sales.

    The maxima are one row computed once, read by a scalar subquery.
    """
    maxima = df.agg(
        F.struct(*[F.max(source).alias(target) for target, source in columns.items()])
    ).scalar()
    return df.withColumns(
        {
            target: F.when(
                maxima[target] > 0, F.col(source) / maxima[target]
            ).otherwise(0.0)
            for target, source in columns.items()
        }
    )


def build_products(raw: DataFrame) -> DataFrame:
    """Products with ids 1..N by name (NULL names last) and all features but the graph ones."""
    filled = fill_defaults(raw)
    kept = [c for c in filled.columns if c not in PRODUCT_COLUMNS]
    numbered = assign_ids(
        filled.select(*PRODUCT_COLUMNS, *kept),
        [F.col("name").asc_nulls_last()],
        "product_id",
    )
    shares = {"popularity_global": "times_sold"} | {
        f"popularity_{s}": s for s in STORE_COLUMNS
    }
    return popularity(numbered, shares).withColumns(
        {
            "age_bucket": age_bucket("min_age"),
            "family_friendly": family_friendly("min_age"),
            "franchise_clean": franchise_clean("franchise"),
            "text_blob": text_blob(
                F.col("name"),
                F.col("segment"),
                F.col("category"),
                F.col("type"),
                F.col("franchise"),
                F.col("min_age"),
                F.col("popularity_global"),
            ),
        }
    )


def catalog_share(
    products: DataFrame, by: str, where: Column | None = None
) -> DataFrame:
    """Products per value of ``by`` with their share of all products that pass ``where``."""
    chosen = products if where is None else products.where(where)
    return share_of_total(chosen, F.col(by), "products")


def share_of_total(df: DataFrame, by: Column, count: str, counted: Column | None = None) -> DataFrame:
    """Rows per group with their ``share`` of all rows; ``counted`` limits which of them the groups count.

    The total adds up the groups, by the same aggregate and from the same shuffle, so the rows are read once.
    """
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    groups = df.groupBy(by).agg(F.count_if(counted).alias(count), F.count(F.lit(1)).alias("_rows"))
    # Never false: it only keeps both counts in the total's aggregate, so that Spark sees the same shuffle.
    all_rows = F.when(F.col(count) <= F.col("_rows"), F.col("_rows"))
    total = groups.agg(F.sum(all_rows)).scalar()
    return (
        groups.where(F.col(count) > 0)
        .withColumn("share", F.col(count) / total)
        .where(F.col("_rows") > 0)
        .drop("_rows")
    )


def share_sets(df: DataFrame, outer: str, inner: str, count: str = "products") -> DataFrame:
    """Rows by ``outer``, by ``inner``, by both and in all, from one scan.

    ``grouping_id`` is 0 for both, 1 for ``outer`` alone, 2 for ``inner`` alone, 3 for all. ``share`` is that of
    the parent: a pair's of its ``outer`` value, everything else's of all rows. NULL is a value like others.
    """
    both = [F.col(outer), F.col(inner)]
    sets = df.groupingSets([both, both[:1], both[1:], []], *both).agg(
        F.grouping_id().cast("int").alias("grouping_id"), F.count(F.lit(1)).alias(count)
    )
    # A parent is in the same aggregate: for pairs the row of their outer value, for the rest that of all.
    pair = F.col("grouping_id") == 0
    scope = F.when(pair | (F.col("grouping_id") == 1), F.col(outer))
    by_outer = Window.partitionBy(F.col("grouping_id") <= 1, scope)
    within = F.max(F.when(F.col("grouping_id") == 1, F.col(count))).over(by_outer)
    whole = sets.agg(F.max(F.when(F.col("grouping_id") == 3, F.col(count)))).scalar()
    return (
        sets.withColumns({"_within": within, "_whole": whole})
        .withColumn("share", F.col(count) / F.when(pair, F.col("_within")).otherwise(F.col("_whole")))
        .drop("_within", "_whole")
    )
