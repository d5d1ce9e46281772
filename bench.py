"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads. Shared tables (gazetteer,
products, edges) are built and timed as entries of their own, the way a user builds them once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.hierarchy import Gazetteer, build_gazetteer, build_hierarchy
from wayfold.operators.matching import match_levels
from wayfold.plans import model, stages
from wayfold.plans.registry import QUERIES
from wayfold.plans.scratch import staged

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
PAIR_COPIES = 20
HEADLINE = (
    "geo_match_levels",
    "geo_match_best",
    "geo_match_strict",
    "geo_resolve",
    "geo_fuzzy",
    "normalize_documents",
    "catalog_products",
    "catalog_share",
    "cooccurrence_baskets",
    "graph_features",
    "undirected_edges",
    "search_products_store",
    "product_fuzzy",
    "product_fuzzy_batch",
    "neighbors_topk",
    "batch_search",
    "recommend",
    "embedding_text",
    "similar_by_embedding",
    "similar_by_embedding_batch",
    "geo_fuzzy_country",
    "catalog_share_sets",
    "log_stats",
    "log_by_intent",
    "log_percentiles",
    "log_rate_breaches",
    "log_feedback_latest",
    "tool_usage",
    "validate_requests",
    "stream_log_metrics",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def warm_gazetteer(spark: SparkSession) -> Gazetteer:
    return build_gazetteer(build_hierarchy(model.tree_nodes(spark, SF_DIR)))


def main() -> None:
    spark = session()
    # Start-up of the JVM and its code paths is not measured.
    run(match_levels(model.place_pairs(spark, SF_DIR), warm_gazetteer(spark)))
    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("stage_gazetteer", lambda: stages.gazetteer(spark, SF_DIR))
    timed("stage_products", lambda: stages.base_products(spark, SF_DIR))
    timed("stage_edges", lambda: stages.edges(spark, SF_DIR))
    timed("stage_final_products", lambda: stages.products(spark, SF_DIR))
    timed("stage_name_index", lambda: stages.name_index(spark, SF_DIR))
    timed("stage_catalog", lambda: stages.catalog(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, SF_DIR)))

    # Pair resolution alone, on a stored table of every pair many times over.
    copies = F.explode(F.sequence(F.lit(1), F.lit(PAIR_COPIES))).alias("copy")
    pairs = model.place_pairs(spark, SF_DIR).repartition(int(CPUS))
    pairs = staged(pairs.select("*", copies), "bench-pairs")
    gaz = stages.gazetteer(spark, SF_DIR)
    rows = pairs.count()
    timed("pair_resolution", lambda: run(match_levels(pairs, gaz)))
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "pair_rows": rows,
                "pair_rows_per_sec": round(rows / seconds["pair_resolution"]),
            }
        )
    )


if __name__ == "__main__":
    main()
