"""Products bought together: matrices, edges, baskets and graph features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.operators.joins import Lookup, lookup_join
from wayfold.plans.scratch import staged, staged_and_measured

# Lines up to which a basket is gathered whole, and items per block of a larger one.
BASKET_BLOCK = 1000
# Baskets are first counted together in so many groups, and exactly only in groups that hold more lines than a block.
BASKET_GROUPS = 1 << 18
# Lines that one task makes pairs of. Pairs are many times the lines, so tasks go by lines and not by their bytes.
TASK_LINES = 100_000
# Shares of the baskets that a task takes, and tasks of lines whose pairs are summed by one.
SHARES, TASKS_A_SUM = 16, 3


def matrix_to_long(matrix: DataFrame) -> DataFrame:
    """Cells of a wide matrix as ``product_1, product_2, count``; empty cells are dropped."""
    label = matrix.columns[0]
    return (
        matrix.withColumnRenamed(label, "product_1")
        .unpivot(["product_1"], None, "product_2", "count")
        .where(F.col("count").isNotNull())
    )


def solo_sales(cells: DataFrame) -> DataFrame:
    """The diagonal: how often each product was sold alone."""
    return cells.where(F.col("product_1") == F.col("product_2")).select(
        F.col("product_1").alias("product_name"), F.col("count").alias("solo_sales")
    )


def undirected_edges(cells: DataFrame, matrix: str = "both") -> DataFrame:
    """One row per unordered pair with positive count.

    ``both`` adds the two triangles (a symmetric matrix counts twice); ``upper`` takes the larger of
    a pair's two cells, so that one filled triangle suffices whatever the order of the labels.
    """
    if matrix not in ("both", "upper"):
        raise ValueError(f"unknown matrix option {matrix!r}")
    first, second, count = F.col("product_1"), F.col("product_2"), F.col("count")
    one_way = [F.sum(F.when(side, count)) for side in (first < second, first > second)]
    return (
        cells.where((first != second) & (count > 0))
        .groupBy(
            F.least(first, second).alias("product_1"),
            F.greatest(first, second).alias("product_2"),
        )
        .agg((F.greatest(*one_way) if matrix == "upper" else F.sum(count)).alias("count"))
    )


def cooccurrence_from_baskets(
    lines: DataFrame, basket: str, item: str, block: int = BASKET_BLOCK
) -> DataFrame:
    """``item_1 < item_2`` with the number of baskets holding both.

    Every pair of items in a basket adds to a row of the result, so pairs have to be produced.
    Baskets of up to ``block`` lines are gathered in one shuffle and paired in place. A larger one
    is never gathered: it is cut into blocks, and every pair of its blocks is worked on apart.
    No pair is lost, and counts are combined on the map side.
    """
    counts, tasks = partial_cooccurrence(lines, basket, item, block)
    return (
        counts.repartition(tasks, "item_1", "item_2")
        .groupBy("item_1", "item_2")
        .agg(F.sum("count").alias("count"))
    )


def partial_cooccurrence(
    lines: DataFrame, basket: str, item: str, block: int = BASKET_BLOCK
) -> tuple[DataFrame, int]:
    """``item_1, item_2, count`` as counted within each task, to be summed, and in how many tasks that should be."""
    rows = lines.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(
        F.col("basket").isNotNull() & F.col("item").isNotNull()
    )
    tasks, large = _large_baskets(rows, block)
    count = F.count(F.lit(1)).alias("count")

    def counted_in_place(small: DataFrame) -> DataFrame:
        # Dealt by share, so that the pairs of a share are counted without another shuffle.
        share = F.pmod(F.xxhash64("basket"), F.lit(SHARES * tasks)).cast("int")
        dealt = small.withColumn("share", share).repartition(tasks, "share")
        return _pairs_in_place(dealt).groupBy("share", "item_1", "item_2").agg(count).drop("share")

    if large is None:
        counts = counted_in_place(rows)
    else:
        marked = lookup_join(rows, large, ["basket"])
        small = marked.where(F.col("blocks").isNull()).drop("blocks")
        big = _pairs_by_block(marked.where(F.col("blocks").isNotNull()))
        counts = counted_in_place(small).unionByName(big.groupBy("item_1", "item_2").agg(count))
    return counts, max(1, tasks // TASKS_A_SUM)


def _large_baskets(rows: DataFrame, block: int) -> tuple[int, Lookup | None]:
    """Tasks for the pairs of all lines, and ``basket, blocks`` of the baskets of more than ``block`` lines, if any.

    A basket is at most as large as its group, so only groups above ``block`` are counted by basket.
    """
    grouped = rows.select("basket", F.pmod(F.xxhash64("basket"), F.lit(BASKET_GROUPS)).cast("int").alias("group"))
    seen = Observation()
    crowded = staged(
        grouped.groupBy("group")
        .agg(F.count(F.lit(1)).alias("lines"))
        .observe(seen, F.sum("lines").alias("lines"), F.count_if(F.col("lines") > block).alias("crowded"))
        .where(F.col("lines") > block)
        .select("group"),
        "crowded-groups",
    )
    tasks = max(1, -(-(seen.get["lines"] or 0) // TASK_LINES))
    if not seen.get["crowded"]:
        return tasks, None
    sizes = (
        lookup_join(grouped, Lookup.over(crowded, ["group"]), ["group"], "left_semi")
        .groupBy("basket")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    large, found, size = staged_and_measured(
        sizes.where(F.col("lines") > block).select(
            "basket", F.ceil(F.col("lines") / block).cast("int").alias("blocks")
        ),
        "large-baskets",
    )
    return tasks, Lookup(large, ("basket",), size) if found else None


def _pairs_in_place(rows: DataFrame) -> DataFrame:
    """Pairs of baskets known to have few lines, with the baskets' ``share``."""
    items = F.array_sort(F.collect_set("item"))
    later = F.slice("items", F.col("pos") + 2, F.size("items"))
    return (
        rows.groupBy("share", "basket")
        .agg(items.alias("items"))
        .where(F.size("items") > 1)
        .select("share", "items", F.posexplode("items").alias("pos", "item_1"))
        .select("share", "item_1", F.explode(later).alias("item_2"))
    )


def _pairs_by_block(rows: DataFrame) -> DataFrame:
    """Pairs of large baskets: items meet per pair of blocks, so no key holds a whole basket."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (
        rows.distinct()
        .withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
        .select("basket", "item", "own", other.alias("other"))
        .select(
            "basket",
            "item",
            "own",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
        )
    )
    left = cells.withColumnsRenamed({"item": "item_1", "own": "own_1"})
    right = cells.withColumnsRenamed({"item": "item_2", "own": "own_2"})
    across = (F.col("low") == F.col("high")) | (F.col("own_1") != F.col("own_2"))
    return (
        left.join(right, ["basket", "low", "high"])
        .where((F.col("item_1") < F.col("item_2")) & across)
        .select("item_1", "item_2")
    )


def solo_from_baskets(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """How many baskets hold only that item."""
    return (
        lines.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(basket).alias("basket"))
        .agg(F.min(item).alias("item"), F.max(item).alias("last"))
        .where(F.col("item") == F.col("last"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("solo_sales"))
    )


def name_ids(products: DataFrame) -> DataFrame:
    """One id per product name; the last id wins for a repeated name."""
    return (
        products.where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.max("product_id").alias("product_id"))
    )


def solo_sales_with_ids(solo: DataFrame, products: DataFrame) -> DataFrame:
    """``product_id, solo_sales``; names without a product are dropped."""
    ids = Lookup.stage(name_ids(products), ["name"], "name-ids")
    return lookup_join(solo, ids, ["product_name"], "inner").select(
        "product_id", "solo_sales"
    )


def edges_with_ids(edges: DataFrame, products: DataFrame) -> DataFrame:
    """Edges between product ids; pairs with an unknown name are dropped."""
    ids = Lookup.stage(name_ids(products), ["name"], "name-ids")

    def end(number: int) -> Lookup:
        renamed = ids.df.withColumnRenamed("product_id", f"product_id_{number}")
        return Lookup(renamed, ids.keys, ids.bytes)

    first = lookup_join(edges, end(1), ["product_1"], "inner")
    return lookup_join(first, end(2), ["product_2"], "inner").select(
        "product_id_1", "product_id_2", F.col("count").alias("cooccurrence_count")
    )


def add_graph_features(
    products: DataFrame, edges: DataFrame, symmetric: bool = False
) -> DataFrame:
    """Add ``num_neighbors`` and ``total_cooccurrence``.

    An edge counts for its first product only; ``symmetric`` lets it count for both ends.
    """
    if symmetric:
        edges = both_directions(edges)
    totals = edges.groupBy(F.col("product_id_1").alias("product_id")).agg(
        F.count("cooccurrence_count").alias("num_neighbors"),
        F.sum("cooccurrence_count").cast("bigint").alias("total_cooccurrence"),
    )

    def filled(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit(0)).cast("bigint")

    return products.join(totals, "product_id", "left").withColumns(
        {c: filled(c) for c in ("num_neighbors", "total_cooccurrence")}
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge once per end, in one pass over the edges."""
    first, second = F.col("product_id_1"), F.col("product_id_2")

    def directed(a: Column, b: Column) -> Column:
        return F.struct(a.alias("product_id_1"), b.alias("product_id_2"))

    ends = F.explode(F.array(directed(first, second), directed(second, first)))
    return edges.select(ends.alias("e"), "cooccurrence_count").select(
        "e.*", "cooccurrence_count"
    )
