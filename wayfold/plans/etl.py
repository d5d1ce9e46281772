"""The catalog load: documents and matrix to staging tables, staging tables to final ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wayfold.operators.catalog import build_products
from wayfold.operators.cooccurrence import (
    add_graph_features,
    edges_with_ids,
    solo_sales,
    solo_sales_with_ids,
    undirected_edges,
)
from wayfold.operators.names import NameIndex
from wayfold.plans.scratch import staged
from wayfold.sources.catalog_files import read_catalog_json, read_matrix_cells
from wayfold.sources.tables import load_raw, write_catalog, write_raw


def stage_catalog(
    spark: SparkSession,
    catalog_path: str,
    matrix_path: str,
    raw_root: str,
    wholetext: bool = True,
) -> None:
    """Read the product documents and the co-purchase matrix into the staging tables.

    ``wholetext=False`` reads one product document per line.
    """
    cells = staged(read_matrix_cells(spark, matrix_path), "matrix-cells")
    write_raw(
        {
            "products_raw": read_catalog_json(spark, catalog_path, wholetext=wholetext),
            "product_cooccurrence_raw": undirected_edges(cells),
            "product_solo_sales_raw": solo_sales(cells),
        },
        raw_root,
    )


def publish_catalog(spark: SparkSession, raw_root: str, root: str) -> str:
    """Build the final tables and the name index from the staging tables and publish them as one version."""
    raw = load_raw(spark, raw_root)
    products = staged(build_products(raw["products_raw"]), "products")
    edges = staged(edges_with_ids(raw["product_cooccurrence_raw"], products), "edges")
    return write_catalog(
        {
            "products": add_graph_features(products, edges),
            "product_solo_sales": solo_sales_with_ids(
                raw["product_solo_sales_raw"], products
            ),
            "product_cooccurrence": edges,
            **NameIndex.build(products).tables(),
        },
        root,
    )
