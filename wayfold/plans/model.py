"""The test tables mapped to the data model: tree, pairs, products, baskets, requests, logs.

Every mapping reads whole tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators.cooccurrence import cooccurrence_from_baskets, solo_from_baskets

# The levels given to the derived tree.
WORLD_LEVEL, REGION_LEVEL, NATION_LEVEL, LEAF_LEVEL = 2, 4, 6, 8
# Offsets which keep the ids of the derived tree apart.
REGION_ID, NATION_ID, LEAF_ID, LEAVES_PER_NATION = 1, 1000, 1_000_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions, nations and the market segments found among each nation's customers."""
    world = spark.sql(
        f"""SELECT 0L AS id, CAST(NULL AS BIGINT) AS parent_id, 0 AS position,
                   'world' AS name, {WORLD_LEVEL} AS admin_level"""
    )
    regions = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + REGION_ID).cast("long").alias("id"),
        F.lit(0).cast("long").alias("parent_id"),
        F.col("r_regionkey").alias("position"),
        F.col("r_name").alias("name"),
        F.lit(REGION_LEVEL).alias("admin_level"),
    )
    nations = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + NATION_ID).cast("long").alias("id"),
        (F.col("n_regionkey") + REGION_ID).cast("long").alias("parent_id"),
        F.col("n_nationkey").alias("position"),
        F.col("n_name").alias("name"),
        F.lit(NATION_LEVEL).alias("admin_level"),
    )
    by_name = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    leaves = (
        table(spark, sf_dir, "customer")
        .select("c_nationkey", "c_mktsegment")
        .distinct()
        .withColumn("position", F.row_number().over(by_name))
        .select(
            (
                F.col("c_nationkey") * LEAVES_PER_NATION + F.col("position") + LEAF_ID
            ).cast("long").alias("id"),
            (F.col("c_nationkey") + NATION_ID).cast("long").alias("parent_id"),
            "position",
            F.col("c_mktsegment").alias("name"),
            F.lit(LEAF_LEVEL).alias("admin_level"),
        )
    )
    return world.unionByName(regions).unionByName(nations).unionByName(leaves)


def place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per order: the customer's segment against that of another customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name"
    )
    other = people.select(
        F.col("c_custkey").alias("id_2"),
        F.col("r_name").alias("country_2"),
        F.col("c_mktsegment").alias("segment_2"),
        F.col("n_name").alias("nation_2"),
    )
    total = customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    key = F.col("o_orderkey")
    city_2 = (
        F.when(key % 11 == 0, "no such place")
        .when(key % 5 == 0, F.col("n_name"))
        .otherwise(F.col("segment_2"))
    )

    def odd_in_lower_case(name: Column) -> Column:
        return F.when(key % 2 == 1, F.lower(name)).otherwise(name)

    return (
        orders.withColumn("id_2", (F.col("o_custkey") * 7 + 3) % total)
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(other, "id_2")
        .select(
            key.alias("id_1"),
            "id_2",
            odd_in_lower_case(F.col("c_mktsegment")).alias("city_1"),
            odd_in_lower_case(
                F.when(key % 4 == 0, F.col("n_name"))
                .when(key % 4 == 1, F.col("r_name"))
                .when(key % 4 == 3, F.lit("nowhere"))
            ).alias("state_1"),
            odd_in_lower_case(city_2).alias("city_2"),
            odd_in_lower_case(
                F.when(key % 3 == 0, F.col("nation_2")).when(key % 3 == 2, F.lit(""))
            ).alias("state_2"),
            F.col("r_name").alias("country_1"),
            "country_2",
        )
    )


def country_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree with every region as a country of its own."""
    region = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + REGION_ID).cast("long").alias("region_id"),
        F.col("r_name").alias("country"),
    )
    nodes = tree_nodes(spark, sf_dir).where(F.col("admin_level") > WORLD_LEVEL)
    nations = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + NATION_ID).cast("long").alias("nation_id"),
        (F.col("n_regionkey") + REGION_ID).cast("long").alias("above_nation"),
    )
    linked = nodes.join(nations, F.col("parent_id") == F.col("nation_id"), "left")
    owner = (
        F.when(F.col("admin_level") == REGION_LEVEL, F.col("id"))
        .when(F.col("admin_level") == NATION_LEVEL, F.col("parent_id"))
        .otherwise(F.col("above_nation"))
    )
    parent = F.when(F.col("admin_level") > REGION_LEVEL, F.col("parent_id"))
    return (
        linked.withColumn("region_id", owner)
        .withColumn("parent_id", parent)
        .join(region, "region_id")
        .select("id", "parent_id", "position", "name", "admin_level", "country")
    )


def tree_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of :func:`tree_nodes` as one nested JSON document."""
    nodes = tree_nodes(spark, sf_dir)
    below = None
    for level in (LEAF_LEVEL, NATION_LEVEL, REGION_LEVEL, WORLD_LEVEL):
        here = nodes.where(F.col("admin_level") == level)
        text = F.concat(F.lit('{"admin_level":'), F.col("admin_level"))
        if below is not None:
            here = here.join(below, F.col("id") == F.col("owner"), "left")
            inner = F.coalesce(F.col("inner"), F.lit(""))
            text = F.concat(text, F.lit(',"children":{'), inner, F.lit("}"))
        text = F.concat(text, F.lit("}"))
        entry = F.concat(F.lit('"'), F.col("name"), F.lit('":'), text)
        below = here.groupBy(F.col("parent_id").alias("owner")).agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))),
                    lambda x: x["e"],
                ),
                ",",
            ).alias("inner"),
            F.first(text).alias("document"),
        )
    return below.select("document")


def misspelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name per customer, some with a letter dropped, changed or added."""
    name, key = F.col("c_mktsegment"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        "c_custkey",
        F.when(key % 4 == 0, F.concat(F.substring(name, 1, 1), F.expr("substr(c_mktsegment, 3)")))
        .when(key % 4 == 1, F.concat(F.lit("x"), F.expr("substr(c_mktsegment, 2)")))
        .when(key % 4 == 2, F.concat(name, F.lit("q")))
        .otherwise(name)
        .alias("city"),
        F.when(key % 2 == 0, F.col("n_name")).alias("state"),
    )


def misspelled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per customer with its country; city and state carry up to two typos each."""
    name, key = F.col("c_mktsegment"), F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select(
        "c_custkey",
        F.when(key % 5 == 0, F.expr("concat(substr(c_mktsegment, 1, 1), substr(c_mktsegment, 3), 'q')"))
        .when(key % 5 == 1, F.expr("concat('x', substr(c_mktsegment, 2))"))
        .when(key % 5 == 2, F.concat(name, F.lit("qz")))
        .when(key % 5 == 3, F.expr("concat('xx', substr(c_mktsegment, 3))"))
        .otherwise(name)
        .alias("city"),
        F.when(key % 7 == 0, "nowhere")
        .when(key % 3 == 0, F.col("n_name"))
        .when(key % 3 == 1, F.expr("concat('z', substr(n_name, 2, length(n_name) - 2))"))
        .alias("state"),
        F.when(key % 11 == 0, "ATLANTIS").when(key % 4 == 0, F.lower("r_name")).otherwise(F.col("r_name")).alias("country"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw products, their sales by store taken from the order lines."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    quantity, store = F.col("l_quantity"), F.col("l_suppkey") % 3
    sales = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            *[
                F.sum(F.when(store == i, quantity)).alias(f"store_{s}")
                for i, s in enumerate("abc")
            ],
            F.sum(quantity).alias("total"),
            F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_sale"),
        )
    )
    kind = F.col("p_type")
    return part.join(sales, key == F.col("l_partkey"), "left").select(
        key.alias("source_key"),
        F.concat("p_name", F.lit(" #"), key).alias("name"),
        F.when(kind == "PROMO", "Console")
        .when(kind == "ECONOMY", "Accessories")
        .otherwise("Games")
        .alias("segment"),
        kind.alias("category"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("type"),
        F.when(key % 10 != 0, F.col("p_brand")).alias("franchise"),
        F.when(key % 7 != 0, F.col("p_size") % 19).alias("min_age"),
        F.when(key % 17 != 0, F.col("total")).alias("times_sold"),
        "store_a",
        "store_b",
        F.when(key % 13 != 0, F.col("store_c")).alias("store_c"),
        F.when(key % 19 == 0, "n/a").otherwise(F.col("first_sale")).alias("release_date"),
    )


# The part types, which label the rows and columns of the wide matrix.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def type_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "p_type"
    )


def type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide symmetric matrix over part types: orders with both, on the diagonal with only one."""
    lines = type_lines(spark, sf_dir)
    pairs = cooccurrence_from_baskets(lines, "l_orderkey", "p_type")
    alone = solo_from_baskets(lines, "l_orderkey", "p_type")
    ends = F.array(
        F.struct(F.col("item_1").alias("row"), F.col("item_2").alias("col")),
        F.struct(F.col("item_2").alias("row"), F.col("item_1").alias("col")),
    )
    cells = (
        pairs.select(F.explode(ends).alias("e"), "count")
        .select("e.*", "count")
        .unionByName(
            alone.select(
                F.col("item").alias("row"),
                F.col("item").alias("col"),
                F.col("solo_sales").alias("count"),
            )
        )
    )
    return cells.groupBy("row").pivot("col", list(PART_TYPES)).agg(F.sum("count"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product request per customer."""
    key = F.col("c_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    total = parts.agg(F.count(F.lit(1))).scalar()
    category = (
        F.when(key % 6 == 1, "Console")
        .when(key % 6 == 2, "Accessories")
        .when(key % 6 == 3, "Other")
        .when(key % 6 == 4, F.lit(None).cast("string"))
        .otherwise("Games")
    )
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey")
        .withColumn("mentioned", (key * 13 + 5) % total)
        .join(parts, F.col("mentioned") == F.col("p_partkey"))
        .select(
            key.alias("request_id"),
            F.when(key % 10 == 0, "unrelated")
            .when(key % 10 == 1, "greeting")
            .when(key % 2 == 0, "search_product")
            .otherwise("recommendation")
            .alias("intent_type"),
            F.struct(
                F.when(key % 5 != 0, (key % 18).cast("int")).alias("max_age"),
                F.when(key % 4 == 0, "Store A")
                .when(key % 4 == 1, "B")
                .when(key % 4 == 2, "store_c")
                .alias("store"),
                category.alias("category"),
                F.when(key % 3 == 0, F.concat(F.lit("Brand#"), key % 25 + 1))
                .when(key % 3 == 2, F.lit(""))
                .alias("exclude_franchise"),
            ).alias("constraints"),
            F.array(F.upper(F.concat("p_name", F.lit(" #"), "p_partkey"))).alias(
                "mentioned_products"
            ),
        )
    )


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request logs."""
    return events_as_logs(table(spark, sf_dir, "events"))


def events_as_logs(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    search, details = F.lit("search_products"), F.lit("get_product_details")
    tools = (
        F.when(key % 4 == 0, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(search))
        .when(key % 4 == 2, F.array(search, details))
        .otherwise(F.array(F.lit("get_product_by_name_fuzzy")))
    )
    return events.select(
        key.alias("log_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"),
        F.col("event_type").alias("intent_type"),
        tools.alias("tools_called"),
        (key % 8 == 0).alias("used_fallback"),
        (key % 11).cast("int").alias("products_returned"),
        (F.col("value") * 10).alias("response_time_ms"),
        (50 + key % 500).cast("int").alias("llm_tokens_used"),
        (F.col("event_type") != "error").alias("success"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ratings per log, some of them out of range."""
    key, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    ratings = F.array(
        F.struct(F.lit(1).alias("hours"), (1 + key % 6).cast("int").alias("rating")),
        F.struct(F.lit(2).alias("hours"), (1 + key % 7).cast("int").alias("rating")),
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            ts.alias("timestamp"),
            F.col("user_id").cast("string").alias("session_id"),
            key.alias("product_id"),
            F.explode(ratings).alias("r"),
        )
        .select(
            "timestamp",
            "session_id",
            (F.col("timestamp") + F.make_dt_interval(hours=F.col("r.hours"))).alias("rated_at"),
            F.col("r.rating").alias("rating"),
            "product_id",
        )
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per log in order; the log's tools are called twice, with other arguments."""
    logs = query_logs(spark, sf_dir)
    twice = F.concat("tools_called", "tools_called")
    return logs.select("log_id", F.posexplode(twice).alias("seq", "tool")).select(
        "log_id", "seq", "tool", F.concat(F.lit("limit="), F.col("seq")).alias("args")
    )


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as request texts; every seventh turn carries a statement."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(turn % 7 == 0, F.concat("text", F.lit(" drop it")))
        .otherwise(F.col("text"))
        .alias("query"),
    )
