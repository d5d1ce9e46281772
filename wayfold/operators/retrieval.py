"""Top-k queries over the product table, for one request or for a table of them.

Products and edges are stored tables. Ties are broken by the smaller ``product_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.product import STORES
from wayfold.operators.cooccurrence import both_directions
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.names import NameIndex, matches

# Columns of the results, the segment searched by default and the phrases of the embedding text.
SEARCH_COLUMNS = (
    "product_id",
    "name",
    "segment",
    "category",
    "type",
    "franchise",
    "min_age",
    "popularity_global",
    "text_blob",
)
DETAIL_COLUMNS = (
    "product_id",
    "name",
    "segment",
    "category",
    "type",
    "franchise",
    "min_age",
    "popularity_global",
    "times_sold",
    "store_a",
    "store_b",
    "store_c",
    "text_blob",
)
NEIGHBOR_COLUMNS = (
    "product_id",
    "name",
    "segment",
    "franchise",
    "min_age",
    "popularity_global",
)
DEFAULT_SEGMENT = "Games"
# Edges that one task sorts.
TASK_EDGES = 1_000_000
COMPANIONS_PHRASE = "Frequently bought with: "
CHILDREN_PHRASE = "Popular with young children and families"
PRETEENS_PHRASE = "Popular with pre-teens"


def store_column(store: str | None) -> str | None:
    """Product column of a store spelled in any known way; None when it is not known."""
    spelled = (store or "").strip().lower()
    return next((key for key, names in STORES.items() if spelled in names), None)


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each key; each task keeps only its own first ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def search_products(
    products: DataFrame,
    store: str | None = None,
    max_age: int | None = None,
    exclude_franchise: str | None = None,
    segment: str | None = DEFAULT_SEGMENT,
    limit: int = 10,
) -> DataFrame:
    """Best-selling products under the given constraints.

    An excluded franchise also drops products whose franchise is unknown, as SQL ``<>`` does.
    An unknown store neither filters nor sorts.
    """
    df = products
    if segment is not None:
        df = df.where(F.col("segment") == segment)
    if max_age is not None:
        df = df.where(F.col("min_age") <= max_age)
    if exclude_franchise:
        df = df.where(F.col("franchise") != exclude_franchise)
    order = [F.col("popularity_global").desc(), F.col("product_id").asc()]
    column = store_column(store)
    if column:
        df = df.where(F.col(column) > 0)
        order.insert(0, F.col(column).desc())
    return df.orderBy(*order).limit(limit).select(*SEARCH_COLUMNS)


def product_details(
    products: DataFrame, product_id: int | None = None, product_name: str | None = None
) -> DataFrame:
    """One product by id or, when the id is not given or 0, by name in any case."""
    if product_id:
        found = products.where(F.col("product_id") == product_id)
    elif product_name is not None:
        same = F.lower("name") == F.lower(F.lit(product_name))
        found = products.where(same).orderBy("product_id")
    else:
        found = products.where(F.lit(False))
    return found.limit(1).select(*DETAIL_COLUMNS)


def product_details_batch(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Details for a table of ``request_id, product_id, product_name``."""
    by_id = products.select(F.col("product_id").alias("found"), F.lit(True).alias("hit"))
    by_name = (
        products.groupBy(F.lower("name").alias("folded"))
        .agg(F.min("product_id").alias("named"))
        .where(F.col("folded").isNotNull())
    )
    names = Lookup.stage(by_name, ["folded"], "product-names")
    given = F.when(F.col("product_id") != 0, F.col("product_id"))
    asked = requests.select(
        "request_id",
        given.alias("found"),
        F.when(given.isNull(), F.lower("product_name")).alias("folded"),
    )
    by_either = lookup_join(
        lookup_join(asked, Lookup.over(by_id, ["found"]), ["found"]), names, ["folded"]
    )
    matched = by_either.select(
        "request_id",
        F.coalesce(F.when(F.col("hit"), F.col("found")), "named").alias("product_id"),
    )
    details = Lookup.over(products.select(*DETAIL_COLUMNS), ["product_id"])
    return lookup_join(matched, details, ["product_id"], "inner").select(
        "request_id", *DETAIL_COLUMNS
    )


def cooccurrence_neighbors(
    edges: DataFrame,
    products: DataFrame,
    product_id: int,
    limit: int = 5,
    symmetric: bool = False,
) -> DataFrame:
    """Products most often bought together with one product."""
    if symmetric:
        edges = both_directions(edges)
    own = edges.where(F.col("product_id_1") == product_id).select(
        F.col("product_id_2").alias("product_id"), "cooccurrence_count"
    )
    return (
        own.join(products.select(*NEIGHBOR_COLUMNS), "product_id")
        .orderBy(F.col("cooccurrence_count").desc(), "product_id")
        .limit(limit)
        .select(*NEIGHBOR_COLUMNS, "cooccurrence_count")
    )


def find_similar_products(
    edges: DataFrame, products: DataFrame, product_id: int, limit: int = 5
) -> DataFrame:
    """Similar products, taken to be those bought together."""
    return cooccurrence_neighbors(edges, products, product_id, limit)


def neighbors_topk(
    edges: DataFrame, products: Lookup | DataFrame, k: int = 5, symmetric: bool = False
) -> DataFrame:
    """The ``k`` neighbours of every product.

    Edges, a stored table, are cut down to ``k`` per product before the product columns are joined. Edges to
    products outside the table do not count. They are dealt to tasks by their number, so that each one is sorted
    once and in memory.
    """
    tasks = -(-edges.count() * (2 if symmetric else 1) // TASK_EDGES)
    if symmetric:
        edges = both_directions(edges)
    if isinstance(products, DataFrame):
        products = Lookup.over(products.select(*NEIGHBOR_COLUMNS), ["product_id"])
    # Ids alone are small where the products with their columns are not; then edges need no shuffle for them.
    known = Lookup.over(products.df.select("product_id"), ["product_id"])
    order = [F.col("cooccurrence_count").desc(), F.col("product_id_2").asc()]
    told = lookup_join(edges, known, ["product_id_2"], "left_semi")
    if tasks > 1:
        told = told.repartition(tasks, "product_id_1")
    kept = top_per_key(told, ["product_id_1"], order, k).withColumnRenamed("product_id_2", "product_id")
    traits = Lookup(products.df.select(*NEIGHBOR_COLUMNS), ("product_id",), products.bytes)
    return lookup_join(kept, traits, ["product_id"], "inner").select(
        "product_id_1", "rank", *NEIGHBOR_COLUMNS, "cooccurrence_count"
    )


def product_fuzzy(
    products: DataFrame, name: str, limit: int = 5, literal: bool = False
) -> DataFrame:
    """Products whose name contains a text in any case, most popular first.

    ``%`` and ``_`` in the text work as wildcards unless ``literal``.
    """
    if literal:
        found = F.contains(F.lower("name"), F.lower(F.lit(name)))
    else:
        found = F.col("name").ilike(f"%{name}%")
    return (
        products.where(found)
        .orderBy(F.col("popularity_global").desc(), "product_id")
        .limit(limit)
        .select(*NEIGHBOR_COLUMNS)
    )


def fuzzy_matches(
    terms: DataFrame, names: NameIndex | DataFrame, k: int = 5, literal: bool = False
) -> DataFrame:
    """For each distinct ``term`` the ``k`` most popular products whose name contains it.

    Returns ``term, rank, product_id``. ``%`` and ``_`` work as wildcards unless ``literal``, see
    :func:`wayfold.operators.names.matches`. ``names`` is the index of the product names; of a product table one is
    built first. A term found in very many names costs no more than ``k`` rows per task, since only the
    most popular are kept before the shuffle. An empty term is contained in every name.
    """
    index = names if isinstance(names, NameIndex) else NameIndex.build(names)
    asked, found = matches(terms, index, literal)
    order = [F.col("popularity_global").desc(), F.col("product_id").asc()]
    best = top_per_key(found, ["text"], order, k)
    return asked.join(best, "text").select("term", "rank", "product_id")


def embedding_text(products: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """``product_id, embedding_text``: name, frequent companions and age group as sentences.

    A ``store_exclusive_features`` column, when there is one, adds the last sentence.
    """
    companions = neighbors_topk(edges, products, k).groupBy(
        F.col("product_id_1").alias("product_id")
    ).agg(
        # At most k rows per product.
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]
            ),
            ", ",
        ).alias("companions")
    )
    age = (
        F.when(F.col("min_age") <= 7, CHILDREN_PHRASE)
        .when(F.col("min_age") <= 12, PRETEENS_PHRASE)
    )
    extra = (
        [F.when(F.col("store_exclusive_features") != "", F.col("store_exclusive_features"))]
        if "store_exclusive_features" in products.columns
        else []
    )

    def known(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit(""))

    head = F.concat(
        known("name"), F.lit(" ("), known("segment"), F.lit(", "), known("franchise"), F.lit(")")
    )
    return products.join(companions, "product_id", "left").select(
        "product_id",
        F.concat_ws(
            ". ",
            head,
            F.concat(F.lit(COMPANIONS_PHRASE), F.col("companions")),
            age,
            *extra,
        ).alias("embedding_text"),
    )
