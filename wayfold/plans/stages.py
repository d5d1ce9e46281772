"""Tables the queries share, built once per session and data folder.

A gazetteer or product catalog is built once and then asked many times; these functions keep that
order. The tables are stored in the scratch folder, not cached in executors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from wayfold.operators import joins
from wayfold.operators.catalog import build_products
from wayfold.operators.cooccurrence import add_graph_features, cooccurrence_from_baskets
from wayfold.operators.hierarchy import Gazetteer, build_gazetteer, build_hierarchy
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.names import NameIndex
from wayfold.operators.requests import Catalog
from wayfold.plans import model
from wayfold.plans.scratch import staged

_built: dict[tuple[str, str, str], Any] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    return once(
        spark,
        sf_dir,
        "gazetteer",
        lambda: build_gazetteer(build_hierarchy(model.tree_nodes(spark, sf_dir))),
    )


def country_gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    return once(
        spark,
        sf_dir,
        "country-gazetteer",
        lambda: build_gazetteer(build_hierarchy(model.country_nodes(spark, sf_dir))),
    )


def base_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without graph features; ``source_key`` is the part they come from."""
    return once(
        spark,
        sf_dir,
        "base-products",
        lambda: staged(build_products(model.raw_products(spark, sf_dir)), "base-products"),
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, product_id`` of the order lines, which are read more than once.

    Stored when the ids are too large to broadcast, so that the lines are dealt by product only once.
    """

    def build() -> DataFrame:
        ids = Lookup.over(base_products(spark, sf_dir).select("source_key", "product_id"), ["source_key"])
        lines = model.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        numbered = lookup_join(lines, ids, ["l_partkey"], "inner").select("l_orderkey", "product_id")
        return numbered if ids.bytes <= joins.BROADCAST_BYTES else staged(numbered, "numbered-lines")

    return once(spark, sf_dir, "numbered-lines", build)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products ordered together. Ids are put in first, so that pairs are two numbers."""

    def build() -> DataFrame:
        pairs = cooccurrence_from_baskets(numbered_lines(spark, sf_dir), "l_orderkey", "product_id")
        return staged(
            pairs.toDF("product_id_1", "product_id_2", "cooccurrence_count"), "edges"
        )

    return once(spark, sf_dir, "edges", build)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final product table."""
    return once(
        spark,
        sf_dir,
        "products",
        lambda: staged(
            add_graph_features(base_products(spark, sf_dir), edges(spark, sf_dir)), "products"
        ),
    )


def name_index(spark: SparkSession, sf_dir: str) -> NameIndex:
    """The index of the product names, built with the catalog."""
    return once(
        spark, sf_dir, "name-index", lambda: NameIndex.build(products(spark, sf_dir))
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Products with the indexes requests are answered from."""
    return once(
        spark,
        sf_dir,
        "catalog",
        lambda: Catalog.build(products(spark, sf_dir), names=name_index(spark, sf_dir)),
    )
