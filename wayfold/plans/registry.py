"""Every registered query: name to a function of the session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.places import path_string, primary_state
from wayfold.functions.product import store_key
from wayfold.functions.text import is_empty, normalize_name
from wayfold.operators import catalog, cooccurrence, edge_store, hierarchy, matching, querylog, rollup
from wayfold.operators import requests as product_requests
from wayfold.operators import retrieval, similarity
from wayfold.plans import model, stages
from wayfold.plans.scratch import scratch_path
from wayfold.sources.catalog_files import read_catalog_json, read_matrix_cells
from wayfold.sources.json_tree import read_hierarchy_json
from wayfold.sources.tables import (
    append_log_stream,
    append_logs,
    append_logs_once,
    load_raw,
    merge_feedback,
    read_catalog,
    read_logs,
    read_name_index,
    validate_feedback,
    write_catalog,
    write_raw,
)
from wayfold.streaming.limits import rate_breaches
from wayfold.streaming.logs import log_metrics, match_stream, window_percentiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USD_PER_1000_TOKENS = 0.2
CALLS_PER_DAY, CALLS_PER_MINUTE = 3, 1
OPPORTUNITY_SHARE = 0.02


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _text_time(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# Text


@query
def normalize_text(spark, sf_dir):
    return model.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        normalize_name("text").alias("folded"),
        is_empty("text").alias("blank"),
    )


@query
def normalize_documents(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select(
        "doc_id", normalize_name("text").alias("folded")
    )


# Hierarchy


@query
def hierarchy_ancestors(spark, sf_dir):
    return stages.gazetteer(spark, sf_dir).nodes.select(
        "id",
        "name",
        "admin_level",
        "parent_id",
        path_string("ancestors").alias("path_text"),
        F.size("ancestors").alias("depth"),
    )


@query
def hierarchy_from_json(spark, sf_dir):
    path = scratch_path(spark, "tree-document")
    model.tree_document(spark, sf_dir).write.text(path)
    nodes = read_hierarchy_json(spark, path, "world")
    return hierarchy.build_hierarchy(nodes).select(
        "id",
        "name",
        "admin_level",
        "parent_id",
        path_string("ancestors").alias("path_text"),
    )


@query
def hierarchy_stats_totals(spark, sf_dir):
    return hierarchy.hierarchy_totals(stages.gazetteer(spark, sf_dir).nodes)


@query
def hierarchy_stats_levels(spark, sf_dir):
    return hierarchy.level_histogram(stages.gazetteer(spark, sf_dir).nodes)


@query
def hierarchy_children(spark, sf_dir):
    return hierarchy.children_counts(stages.gazetteer(spark, sf_dir).nodes)


@query
def hierarchy_primary_state(spark, sf_dir):
    return stages.gazetteer(spark, sf_dir).nodes.select(
        "id", primary_state("ancestors").alias("state")
    )


@query
def hierarchy_named(spark, sf_dir):
    places = hierarchy.locations_named(stages.gazetteer(spark, sf_dir).nodes, " Building ")
    return places.select("id", "name", path_string("ancestors").alias("path_text"))


# Place matching


@query
def geo_resolve(spark, sf_dir):
    people = model.table(spark, sf_dir, "customer").join(
        model.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    asked = people.select(
        "c_custkey",
        F.col("c_mktsegment").alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).alias("state"),
    )
    found = matching.resolve(asked, stages.gazetteer(spark, sf_dir))
    return found.select("c_custkey", "city", "state", "n", F.col("first.id").alias("first_id"))


def _match(spark, sf_dir, **options) -> DataFrame:
    pairs = model.place_pairs(spark, sf_dir)
    return matching.match_levels(pairs, stages.gazetteer(spark, sf_dir), **options)


@query
def geo_match_levels(spark, sf_dir):
    return _match(spark, sf_dir)


@query
def geo_match_best(spark, sf_dir):
    return _match(spark, sf_dir, mode="best")


@query
def geo_match_strict(spark, sf_dir):
    return _match(spark, sf_dir, strict_state=True)


@query
def geo_match_country(spark, sf_dir):
    return matching.match_levels(
        model.place_pairs(spark, sf_dir),
        stages.country_gazetteer(spark, sf_dir),
        country=("country_1", "country_2"),
    )


@query
def geo_containment(spark, sf_dir):
    return hierarchy.containment_pairs(stages.gazetteer(spark, sf_dir).nodes)


@query
def geo_fuzzy(spark, sf_dir):
    found = matching.resolve_fuzzy(
        model.misspelled(spark, sf_dir), stages.gazetteer(spark, sf_dir)
    )
    return found.select(
        "c_custkey", "city", "corrected_city", "n", F.col("first.id").alias("first_id")
    )


@query
def geo_fuzzy_far(spark, sf_dir):
    """City names with up to two typos."""
    found = matching.resolve_fuzzy(
        model.misspelled_places(spark, sf_dir), stages.gazetteer(spark, sf_dir), max_distance=2
    )
    return found.select(
        "c_custkey", "city", "corrected_city", "n", F.col("first.id").alias("first_id")
    )


@query
def geo_fuzzy_country(spark, sf_dir):
    """Cities and states with up to two typos each, corrected together within their country."""
    found = matching.resolve_fuzzy(
        model.misspelled_places(spark, sf_dir),
        stages.country_gazetteer(spark, sf_dir),
        max_distance=2,
        country="country",
        correct_state=True,
    )
    return found.select(
        "c_custkey", "corrected_city", "corrected_state", "n", F.col("first.id").alias("first_id")
    )


# Catalog


def _product_columns(products: DataFrame) -> DataFrame:
    return products.withColumn(
        "release_date", F.date_format("release_date", "yyyy-MM-dd")
    )


@query
def catalog_products(spark, sf_dir):
    return _product_columns(stages.base_products(spark, sf_dir))


def _read_documents(spark, sf_dir, times_sold, *more) -> DataFrame:
    """Raw products written as documents and read again."""
    path = scratch_path(spark, "product-documents")
    item = F.to_json(
        F.struct(
            "name",
            "release_date",
            times_sold.alias("times_sold"),
            F.col("store_a").alias("Store A"),
            F.col("store_b").alias("Store B"),
            F.col("store_c").alias("Store C"),
            "type",
            "category",
            "franchise",
            "min_age",
            *more,
        )
    )
    # One document per item, so that no document grows with the table.
    document = F.concat(
        F.lit('{"'), F.col("segment"), F.lit('":['), item, F.lit("]}")
    )
    model.raw_products(spark, sf_dir).select(document).write.text(path)
    return read_catalog_json(spark, path, wholetext=False)


@query
def catalog_raw_tables(spark, sf_dir):
    """Rows and total sales of the staging tables, written and read back."""
    root = scratch_path(spark, "raw-tables")
    cells = _type_cells(spark, sf_dir)
    write_raw(
        {
            "products_raw": model.raw_products(spark, sf_dir),
            "product_solo_sales_raw": cells.where("product_1 = product_2"),
            "product_cooccurrence_raw": cells.where("product_1 <> product_2"),
        },
        root,
    )
    raw = load_raw(spark, root)
    summed = {
        "products_raw": "source_key",
        "product_solo_sales_raw": "count",
        "product_cooccurrence_raw": "count",
    }
    totals = [
        raw[name].agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(col).cast("bigint").alias("total"),
        )
        for name, col in summed.items()
    ]
    return totals[0].union(totals[1]).union(totals[2])


@query
def catalog_missing_columns(spark, sf_dir):
    """Defaults of a raw product table that lacks some of its columns."""
    raw = model.raw_products(spark, sf_dir).drop("store_c", "franchise", "min_age")
    return catalog.fill_defaults(raw).select(
        "source_key", "name", "store_c", "franchise", "min_age"
    )


@query
def catalog_extra_keys(spark, sf_dir):
    key = F.col("source_key")
    extra = F.when(key % 2 == 1, key).alias("Part Key")
    items = _read_documents(spark, sf_dir, F.col("times_sold").cast("string"), extra)
    return items.select("name", "times_sold", "part_key")


@query
def catalog_from_json(spark, sf_dir):
    items = _read_documents(spark, sf_dir, F.col("times_sold"))
    return _product_columns(
        items.select(
            "segment",
            "name",
            "release_date",
            "times_sold",
            "store_a",
            "store_b",
            "store_c",
            "type",
            "category",
            "franchise",
            "min_age",
        )
    )


def _published(spark, sf_dir) -> dict[str, DataFrame]:
    """The catalog's tables, published as a version and read back."""

    def build() -> dict[str, DataFrame]:
        root = scratch_path(spark, "catalog")
        solo = cooccurrence.solo_from_baskets(stages.numbered_lines(spark, sf_dir), "l_orderkey", "product_id")
        write_catalog(
            {
                "products": stages.products(spark, sf_dir),
                "product_solo_sales": solo.withColumnRenamed("item", "product_id"),
                "product_cooccurrence": stages.edges(spark, sf_dir),
            },
            root,
        )
        return read_catalog(spark, root)

    return stages.once(spark, sf_dir, "published", build)


@query
def catalog_published(spark, sf_dir):
    tables = _published(spark, sf_dir)
    return tables["products"].join(tables["product_solo_sales"], "product_id").select(
        "product_id", "name", "num_neighbors", "total_cooccurrence", "solo_sales"
    )


@query
def catalog_published_edges(spark, sf_dir):
    """Every product of the published catalog with its edges, those without any included."""
    tables = _published(spark, sf_dir)
    edges = tables["product_cooccurrence"].withColumnRenamed("product_id_1", "product_id")
    return tables["products"].select("product_id").join(edges, "product_id", "left")


@query
def catalog_share(spark, sf_dir):
    return catalog.catalog_share(
        stages.base_products(spark, sf_dir), "segment", F.col("min_age") <= 12
    )


@query
def catalog_share_sets(spark, sf_dir):
    """Products by segment, by category, by both and in all, with the share of their parent."""
    return _rounded(catalog.share_sets(stages.base_products(spark, sf_dir), "segment", "category"), "share")


@query
def store_keys(spark, sf_dir):
    asked = model.requests(spark, sf_dir)
    return asked.select("request_id", store_key(F.col("constraints.store")).alias("store"))


# Co-occurrence


def _type_cells(spark, sf_dir) -> DataFrame:
    return cooccurrence.matrix_to_long(model.type_matrix(spark, sf_dir))


@query
def matrix_from_file(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    model.type_matrix(spark, sf_dir).coalesce(1).write.option("header", True).csv(path)
    return read_matrix_cells(spark, path).withColumn("count", F.col("count").cast("long"))


@query
def matrix_long(spark, sf_dir):
    return _type_cells(spark, sf_dir)


@query
def solo_sales(spark, sf_dir):
    return cooccurrence.solo_sales(_type_cells(spark, sf_dir))


@query
def undirected_edges(spark, sf_dir):
    return cooccurrence.undirected_edges(_type_cells(spark, sf_dir))


@query
def undirected_edges_upper(spark, sf_dir):
    return cooccurrence.undirected_edges(_type_cells(spark, sf_dir), matrix="upper")


@query
def cooccurrence_baskets(spark, sf_dir):
    lines = model.table(spark, sf_dir, "lineitem")
    return cooccurrence.cooccurrence_from_baskets(lines, "l_orderkey", "l_partkey")


@query
def solo_baskets(spark, sf_dir):
    lines = model.table(spark, sf_dir, "lineitem")
    return cooccurrence.solo_from_baskets(lines, "l_orderkey", "l_partkey")


def _kept_edges(spark, sf_dir) -> str:
    """Stored edges of most baskets, then changed by new, withdrawn and changed ones."""

    def build() -> str:
        root = scratch_path(spark, "edge-store")
        lines = model.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        key = F.col("l_orderkey")
        # Every thirteenth basket comes later, every eleventh is there at first only in part.
        first = lines.where((key % 13 != 0) & ((key % 11 != 0) | (F.col("l_linenumber") != 1)))
        edge_store.create(first, "l_orderkey", "l_partkey", root)
        later = lines.where((key % 13 == 0) | (key % 11 == 0))
        gone = first.where(key % 11 == 0)
        edge_store.apply_changes(spark, root, later, gone, "l_orderkey", "l_partkey")
        return root

    return stages.once(spark, sf_dir, "edge-store", build)


@query
def edges_maintained(spark, sf_dir):
    return edge_store.read(spark, _kept_edges(spark, sf_dir), edge_store.EDGES)


@query
def solo_maintained(spark, sf_dir):
    return edge_store.read(spark, _kept_edges(spark, sf_dir), edge_store.SOLO)


@query
def degrees_maintained(spark, sf_dir):
    return edge_store.read(spark, _kept_edges(spark, sf_dir), edge_store.DEGREES)


def _named_lines(spark, sf_dir) -> DataFrame:
    part = model.table(spark, sf_dir, "part")
    named = part.select("p_partkey", F.concat("p_name", F.lit(" #"), "p_partkey").alias("name"))
    lines = model.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(named, F.col("l_partkey") == F.col("p_partkey"))


@query
def cooccurrence_ids(spark, sf_dir):
    pairs = cooccurrence.cooccurrence_from_baskets(
        _named_lines(spark, sf_dir), "l_orderkey", "name"
    )
    named = pairs.toDF("product_1", "product_2", "count")
    return cooccurrence.edges_with_ids(named, stages.base_products(spark, sf_dir))


def _known_products(spark, sf_dir) -> DataFrame:
    """Products but for every third one, so that names of the others are unknown."""
    return stages.base_products(spark, sf_dir).where(F.col("source_key") % 3 != 0)


@query
def cooccurrence_ids_known(spark, sf_dir):
    """Edges between known names; a third of the names is not, and their edges go."""
    pairs = cooccurrence.cooccurrence_from_baskets(
        _named_lines(spark, sf_dir), "l_orderkey", "name"
    )
    named = pairs.toDF("product_1", "product_2", "count")
    return cooccurrence.edges_with_ids(named, _known_products(spark, sf_dir))


@query
def solo_sales_ids_known(spark, sf_dir):
    solo = cooccurrence.solo_from_baskets(_named_lines(spark, sf_dir), "l_orderkey", "name")
    return cooccurrence.solo_sales_with_ids(
        solo.withColumnRenamed("item", "product_name"), _known_products(spark, sf_dir)
    )


@query
def solo_sales_ids(spark, sf_dir):
    solo = cooccurrence.solo_from_baskets(_named_lines(spark, sf_dir), "l_orderkey", "name")
    return cooccurrence.solo_sales_with_ids(
        solo.withColumnRenamed("item", "product_name"), stages.base_products(spark, sf_dir)
    )


@query
def graph_features(spark, sf_dir):
    featured = cooccurrence.add_graph_features(
        stages.base_products(spark, sf_dir), stages.edges(spark, sf_dir)
    )
    return featured.select("product_id", "num_neighbors", "total_cooccurrence")


@query
def graph_features_symmetric(spark, sf_dir):
    featured = cooccurrence.add_graph_features(
        stages.base_products(spark, sf_dir), stages.edges(spark, sf_dir), symmetric=True
    )
    return featured.select("product_id", "num_neighbors", "total_cooccurrence")


# Retrieval


@query
def search_products_plain(spark, sf_dir):
    return retrieval.search_products(stages.products(spark, sf_dir))


@query
def search_products_store(spark, sf_dir):
    return retrieval.search_products(
        stages.products(spark, sf_dir), store="Store A", max_age=7, limit=3
    )


@query
def search_products_exclude(spark, sf_dir):
    return retrieval.search_products(
        stages.products(spark, sf_dir),
        store="b",
        max_age=12,
        exclude_franchise="Brand#3",
        segment="Console",
    )


@query
def product_details(spark, sf_dir):
    return retrieval.product_details(stages.products(spark, sf_dir), product_id=1)


@query
def product_details_by_name(spark, sf_dir):
    return retrieval.product_details(
        stages.products(spark, sf_dir), product_id=0, product_name="RED WIDGET #1"
    )


@query
def product_details_batch(spark, sf_dir):
    key = F.col("c_custkey")
    total = model.table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    mentioned = model.requests(spark, sf_dir).select(
        "request_id", F.col("mentioned_products")[0].alias("product_name")
    )
    ids = model.table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 3 == 0, key % total + 1).when(key % 3 == 1, F.lit(0)).alias("product_id"),
    )
    return retrieval.product_details_batch(
        ids.join(mentioned, "request_id"), stages.products(spark, sf_dir)
    )


@query
def neighbors_single(spark, sf_dir):
    return retrieval.cooccurrence_neighbors(
        stages.edges(spark, sf_dir), stages.products(spark, sf_dir), product_id=1, limit=3
    )


@query
def similar_products(spark, sf_dir):
    return retrieval.find_similar_products(
        stages.edges(spark, sf_dir), stages.products(spark, sf_dir), product_id=2
    )


@query
def neighbors_topk(spark, sf_dir):
    return retrieval.neighbors_topk(
        stages.edges(spark, sf_dir), stages.products(spark, sf_dir)
    )


@query
def neighbors_topk_symmetric(spark, sf_dir):
    return retrieval.neighbors_topk(
        stages.edges(spark, sf_dir), stages.products(spark, sf_dir), symmetric=True
    )


@query
def product_fuzzy(spark, sf_dir):
    return retrieval.product_fuzzy(stages.products(spark, sf_dir), "Widget", limit=3)


@query
def product_fuzzy_wildcard(spark, sf_dir):
    return retrieval.product_fuzzy(stages.products(spark, sf_dir), "RED%1_")


@query
def product_fuzzy_batch(spark, sf_dir):
    terms = model.requests(spark, sf_dir).select(
        F.explode("mentioned_products").alias("term")
    )
    return retrieval.fuzzy_matches(terms, stages.name_index(spark, sf_dir))


@query
def product_fuzzy_batch_wildcard(spark, sf_dir):
    mentioned = F.explode("mentioned_products").alias("term")
    terms = model.requests(spark, sf_dir).select(mentioned).select(
        F.concat(F.substring("term", 1, 2), F.lit("%"), F.expr("right(term, 1)"), F.lit("_")).alias("term")
    )
    return retrieval.fuzzy_matches(terms, stages.name_index(spark, sf_dir))


@query
def product_fuzzy_published(spark, sf_dir):
    """Terms of none to five characters, looked up in the index published with the catalog."""
    root = scratch_path(spark, "catalog-names")
    products = stages.products(spark, sf_dir)
    solo = cooccurrence.solo_from_baskets(stages.numbered_lines(spark, sf_dir), "l_orderkey", "product_id")
    write_catalog(
        {
            "products": products,
            "product_solo_sales": solo.withColumnRenamed("item", "product_id"),
            "product_cooccurrence": stages.edges(spark, sf_dir),
            **stages.name_index(spark, sf_dir).tables(),
        },
        root,
    )
    size = F.pmod(F.col("p_partkey"), F.lit(6)).cast("int")
    start = F.pmod(F.col("p_partkey"), F.lit(9)).cast("int") + 1
    terms = products.join(
        model.table(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey") == F.col("source_key")
    ).select(F.substr("name", start, size).alias("term"))
    return retrieval.fuzzy_matches(terms, read_name_index(spark, root))


@query
def batch_search(spark, sf_dir):
    return product_requests.batch_search(model.requests(spark, sf_dir), stages.catalog(spark, sf_dir))


@query
def request_messages(spark, sf_dir):
    return product_requests.request_messages(model.requests(spark, sf_dir))


@query
def filter_by_constraints(spark, sf_dir):
    total = model.table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    steps = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")
    candidates = (
        model.table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("request_id"), steps)
        .withColumn("product_id", (F.col("request_id") * 7 + F.col("step") * 11) % total + 1)
        .select("request_id", "product_id")
        .distinct()
    )
    return product_requests.filter_by_constraints(
        candidates, model.requests(spark, sf_dir), stages.catalog(spark, sf_dir)
    )


@query
def recommend(spark, sf_dir):
    return product_requests.recommend(
        model.requests(spark, sf_dir),
        stages.catalog(spark, sf_dir),
        stages.edges(spark, sf_dir),
    )


@query
def embedding_text(spark, sf_dir):
    return retrieval.embedding_text(
        stages.products(spark, sf_dir), stages.edges(spark, sf_dir)
    )


@query
def similar_by_embedding(spark, sf_dir):
    vectors = model.table(spark, sf_dir, "embeddings")
    return _rounded(
        similarity.similar_by_embedding(vectors, [0, 1, 2]), "similarity"
    )


@query
def similar_by_embedding_batch(spark, sf_dir):
    vectors = model.table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 10 == 0).select("vec_id")
    return _rounded(similarity.similar_by_embedding_batch(vectors, asked), "similarity")


# Request logs


@query
def log_stats(spark, sf_dir):
    stats = querylog.log_stats(model.query_logs(spark, sf_dir))
    return _rounded(stats, *stats.columns[1:])


@query
def tool_usage(spark, sf_dir):
    return querylog.tool_usage(model.query_logs(spark, sf_dir))


@query
def log_by_intent(spark, sf_dir):
    return _performance(spark, sf_dir, "intent_type")


@query
def log_by_success(spark, sf_dir):
    return _performance(spark, sf_dir, "success")


def _performance(spark, sf_dir, by: str) -> DataFrame:
    result = querylog.performance_by(model.query_logs(spark, sf_dir), by)
    return _rounded(result, "avg_latency", "avg_results", "success_rate")


@query
def log_fallback_top(spark, sf_dir):
    return querylog.fallback_queries(model.query_logs(spark, sf_dir))


@query
def log_failed_top(spark, sf_dir):
    return querylog.failed_queries(model.query_logs(spark, sf_dir))


@query
def log_percentiles(spark, sf_dir):
    result = querylog.latency_percentiles(model.query_logs(spark, sf_dir))
    return _rounded(result, "p50", "p95", "p99")


@query
def log_intents(spark, sf_dir):
    return _rounded(querylog.intent_distribution(model.query_logs(spark, sf_dir)), "share")


@query
def log_opportunities(spark, sf_dir):
    logs = model.query_logs(spark, sf_dir)
    pattern = F.split_part("query", F.lit(" "), F.lit(1))
    return _rounded(querylog.tool_opportunities(logs, pattern, OPPORTUNITY_SHARE), "share")


@query
def log_monthly_budget(spark, sf_dir):
    logs = model.query_logs(spark, sf_dir)
    result = querylog.budget_flags(logs, USD_PER_1000_TOKENS, token_cap=500)
    return _rounded(result, "cost_usd")


@query
def log_rate_breaches(spark, sf_dir):
    limits = [("free", CALLS_PER_MINUTE, CALLS_PER_DAY), ("premium", 10, 6)]
    logs = model.query_logs(spark, sf_dir)
    users = logs.select("session_id").distinct()
    tier = F.when(F.col("session_id").cast("bigint") % 4 == 0, "premium").otherwise("free")
    result = querylog.rate_limit_breaches(
        logs, "session_id", users.withColumn("tier", tier), limits
    )
    return result.withColumn("start", _text_time("start"))


def _rollup(spark, sf_dir) -> DataFrame:
    """The rollup of logs that came in two goes, the second one late rows of some days."""

    def build() -> DataFrame:
        logs = model.query_logs(spark, sf_dir)
        path, kept = scratch_path(spark, "rolled-logs"), scratch_path(spark, "rollup")
        late = F.col("log_id") % 97 == 0
        for part in (logs.where(~late), logs.where(late)):
            append_logs(part, path)
            rollup.refresh_rollup(spark, path, kept, token_cap=500)
        return spark.read.parquet(kept)

    return stages.once(spark, sf_dir, "log-rollup", build)


@query
def log_rollup_stats(spark, sf_dir):
    stats = rollup.stats(_rollup(spark, sf_dir))
    return _rounded(stats, *stats.columns[1:])


@query
def log_rollup_by_intent(spark, sf_dir):
    result = rollup.performance(_rollup(spark, sf_dir)).drop("sessions")
    return _rounded(result, "avg_latency", "avg_results", "success_rate")


@query
def log_rollup_budget(spark, sf_dir):
    return _rounded(rollup.budget(_rollup(spark, sf_dir), USD_PER_1000_TOKENS), "cost_usd")


LEVELS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _ranks_hold(found: DataFrame, logs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the rank of each reported percentile is as near the wanted one as the sketch states."""
    met = logs.where(F.col("response_time_ms").isNotNull()).join(F.broadcast(found), keys)
    value = F.col("response_time_ms")
    checks = []
    for name, level in LEVELS.items():
        low = F.count_if(value < F.col(name)) / F.count(F.lit(1)) <= level + rollup.RANK_ERROR
        high = F.count_if(value <= F.col(name)) / F.count(F.lit(1)) >= level - rollup.RANK_ERROR
        checks.append((low & high).alias(name))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("timed"), *checks)


@query
def log_rollup_percentiles(spark, sf_dir):
    found = rollup.percentiles(_rollup(spark, sf_dir), LEVELS)
    return _ranks_hold(found, model.query_logs(spark, sf_dir), ["intent_type"])


@query
def log_rollup_sessions(spark, sf_dir):
    """Exact numbers of sessions by intent, and whether the sketches' estimates are within 5 %."""
    found = rollup.performance(_rollup(spark, sf_dir)).select("intent_type", F.col("sessions").alias("estimate"))
    exact = model.query_logs(spark, sf_dir).groupBy("intent_type").agg(F.count_distinct("session_id").alias("sessions"))
    near = F.abs(F.col("estimate") - F.col("sessions")) <= 0.05 * F.col("sessions")
    return exact.join(found, "intent_type").select("intent_type", "sessions", near.alias("near"))


@query
def log_latest(spark, sf_dir):
    result = querylog.latest_logs(model.query_logs(spark, sf_dir))
    return result.select("log_id", "session_id", "query", "intent_type", "success")


@query
def log_feedback_latest(spark, sf_dir):
    rated = querylog.apply_feedback(
        model.query_logs(spark, sf_dir), model.feedback(spark, sf_dir)
    )
    return rated.select("log_id", "session_id", "user_feedback", "user_clicked_product")


@query
def log_feedback_summary(spark, sf_dir):
    rated = querylog.apply_feedback(
        model.query_logs(spark, sf_dir), model.feedback(spark, sf_dir)
    )
    return _rounded(querylog.feedback_summary(rated, "intent_type"), "mean_rating")


@query
def log_feedback_rejected(spark, sf_dir):
    _, rejected = validate_feedback(model.feedback(spark, sf_dir))
    return rejected.groupBy("rating").agg(F.count(F.lit(1)).alias("rows"))


@query
def log_tool_arguments(spark, sf_dir):
    arguments = querylog.tool_arguments(model.tool_calls(spark, sf_dir))
    return arguments.select("log_id", F.to_json("tool_arguments").alias("arguments"))


@query
def logs_json(spark, sf_dir):
    logs = model.query_logs(spark, sf_dir).withColumn(
        "tool_arguments", F.create_map(F.lit("intent"), "intent_type")
    )
    return querylog.logs_to_json(logs).select(
        "log_id", "timestamp", "tools_called", "tool_arguments"
    )


@query
def validate_requests(spark, sf_dir):
    result = querylog.validate_requests(model.request_texts(spark, sf_dir))
    return result.select("conv_id", "turn", "rejected_for")


def _metrics_as_text(metrics: DataFrame) -> DataFrame:
    return _rounded(metrics, "success_rate", "avg_latency").withColumns(
        {c: _text_time(c) for c in ("window_start", "window_end")}
    )


@query
def log_window_metrics(spark, sf_dir):
    return _metrics_as_text(log_metrics(model.query_logs(spark, sf_dir), "1 hour"))


@query
def stream_log_metrics(spark, sf_dir):
    """The same numbers from a stream over the event file, in append mode.

    A window is written once the watermark passes its end, and its state then goes. A closing row a
    day after the last event, in a window of its own that never closes, lets all others end.
    """
    events = model.table(spark, sf_dir, "events")
    late = F.max(F.col("timestamp").cast("timestamp")) + F.expr("interval 1 day")
    closing = scratch_path(spark, "stream-closing")
    last = model.query_logs(spark, sf_dir).agg(late.alias("timestamp"))
    last.write.parquet(closing)
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    closed = spark.readStream.schema(last.schema).parquet(closing)
    logs = model.events_as_logs(stream).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    metrics = log_metrics(logs.unionByName(closed, allowMissingColumns=True), "1 hour")
    return _metrics_as_text(_streamed(spark, metrics, "stream-metrics"))


def _log_stream(spark, sf_dir, label: str) -> DataFrame:
    """The event file as a stream of logs, with a closing row that lets all others pass the watermark."""
    events = model.table(spark, sf_dir, "events")
    closing = scratch_path(spark, f"{label}-closing")
    late = F.max(F.col("timestamp").cast("timestamp")) + F.expr("interval 3 day")
    last = model.query_logs(spark, sf_dir).agg(late.alias("timestamp"))
    last.write.parquet(closing)
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    closed = spark.readStream.schema(last.schema).parquet(closing)
    logs = model.events_as_logs(stream).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return logs.unionByName(closed, allowMissingColumns=True)


@query
def stream_log_percentiles(spark, sf_dir):
    """Percentiles of the windows of a stream, and whether their ranks are as near as stated."""
    stream = _log_stream(spark, sf_dir, "stream-percentiles")
    found = _streamed(spark, window_percentiles(stream, LEVELS, "1 day"), "stream-percentiles")
    logs = model.query_logs(spark, sf_dir).withColumn("window_start", F.window("timestamp", "1 day")["start"])
    held = _ranks_hold(found.where("timed > 0"), logs, ["window_start", "intent_type"])
    return held.withColumn("window_start", _text_time("window_start"))


@query
def stream_rate_breaches(spark, sf_dir):
    """Calls beyond a limit in the last 60 seconds or 24 hours, from a stream."""
    stream = _log_stream(spark, sf_dir, "stream-limits")
    limits = {"minute": CALLS_PER_MINUTE, "day": CALLS_PER_DAY}
    found = _streamed(spark, rate_breaches(stream, "session_id", limits), "stream-breaches")
    return found.withColumn("called", F.date_format("called", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def logs_once(spark, sf_dir):
    """Logs by day from a stream that brings many of them twice."""
    path, source = scratch_path(spark, "logs-once"), scratch_path(spark, "logs-twice")
    logs = model.query_logs(spark, sf_dir)
    logs.unionByName(logs.where(F.col("log_id") % 3 == 0)).write.parquet(source)
    stream = spark.readStream.schema(logs.schema).parquet(source)
    append_logs_once(stream, path, scratch_path(spark, "logs-once-state"), watermark="400 days").awaitTermination()
    return _by_day(spark.read.parquet(path))


@query
def logs_feedback_merged(spark, sf_dir):
    """Logs after their feedback was merged into the stored days, twice."""
    path = scratch_path(spark, "merged-logs")
    append_logs(model.query_logs(spark, sf_dir), path)
    feedback = model.feedback(spark, sf_dir)
    merge_feedback(spark, path, feedback.where(F.hour("rated_at") % 2 == 0))
    merge_feedback(spark, path, feedback)
    merge_feedback(spark, path, feedback)
    return read_logs(spark, path).select("log_id", "session_id", "user_feedback", "user_clicked_product")


def _streamed(spark, rows: DataFrame, label: str) -> DataFrame:
    """What a stream has written once it has read all there is."""
    out = scratch_path(spark, label)
    running = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _by_day(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("llm_tokens_used").alias("tokens")
    )


@query
def logs_appended(spark, sf_dir):
    """Logs appended in two goes and read back by day."""
    path = scratch_path(spark, "appended-logs")
    logs = model.query_logs(spark, sf_dir)
    append_logs(logs.where("success"), path)
    append_logs(logs.where("success is null or not success"), path)
    return _by_day(spark.read.parquet(path))


@query
def logs_appended_stream(spark, sf_dir):
    """Logs appended by a stream over the event file and read back by day."""
    events = model.table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    path = scratch_path(spark, "streamed-logs")
    logs = model.events_as_logs(stream)
    append_log_stream(logs, path, scratch_path(spark, "streamed-logs-state")).awaitTermination()
    days = logs.withColumn("day", F.to_date("timestamp"))
    return _by_day(spark.read.schema(days.schema).parquet(path))


@query
def geo_match_stream(spark, sf_dir):
    """Pairs of places scored as a stream over a written table of them."""
    path = scratch_path(spark, "streamed-pairs")
    pairs = model.place_pairs(spark, sf_dir)
    pairs.write.parquet(path)
    stream = spark.readStream.schema(pairs.schema).parquet(path)
    scored = match_stream(stream, stages.gazetteer(spark, sf_dir))
    return _streamed(spark, scored, "streamed-matches")
