"""Answer a table of product requests: constrained search, candidate filters, recommendations.

Products and edges are stored tables; a :class:`Catalog` of the products saves building their indexes again. A request has ``request_id, intent_type, constraints`` and ``mentioned_products``. The struct
``constraints`` has ``store, max_age, category, exclude_franchise``; other fields are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.product import STORES, store_key
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.names import NameIndex
from wayfold.operators.retrieval import (
    DEFAULT_SEGMENT,
    SEARCH_COLUMNS,
    fuzzy_matches,
    neighbors_topk,
    top_per_key,
)
from wayfold.plans.scratch import staged

# Intents, segments and the replies to requests that are not searched.
SEARCH_INTENTS = ("search_product", "recommendation")
SEGMENTS = ("Games", "Console", "Accessories")
MESSAGES = {
    "unrelated": "I can only help with Nintendo Switch products.",
    "greeting": "Hello! How can I help you with Nintendo Switch games today?",
}
SEARCH_LIMIT = 5

# Ages are 32-bit integers, moved to start at 0.
_AGE_BITS = 32
_AGE_SHIFT = 1 << 31
_ANY_AGE = -1
_COMBO = ["segment", "store", "age", "excluded"]


def request_messages(requests: DataFrame) -> DataFrame:
    """The fixed reply of every request that needs no search."""
    message = F.lit(None).cast("string")
    for intent, text in MESSAGES.items():
        message = F.when(F.col("intent_type") == intent, text).otherwise(message)
    return requests.select(
        "request_id", "intent_type", message.alias("message")
    ).where(F.col("message").isNotNull())


def with_constraints(requests: DataFrame) -> DataFrame:
    """Effective constraints: unknown categories mean games, unknown stores and '' mean none."""
    category = F.col("constraints.category")
    return requests.withColumns(
        {
            "segment": F.when(category.isin(*SEGMENTS), category).otherwise(DEFAULT_SEGMENT),
            "store": F.coalesce(store_key(F.col("constraints.store")), F.lit("")),
            "max_age": F.col("constraints.max_age").cast("int"),
            "excluded": F.coalesce(F.col("constraints.exclude_franchise"), F.lit("")),
        }
    ).withColumn("age", F.coalesce(F.col("max_age").cast("string"), F.lit("")))


@dataclass(frozen=True)
class Catalog:
    """What requests are answered from, built and measured once: products, search index and name index."""

    products: Lookup
    index: Lookup
    names: NameIndex
    limit: int

    @classmethod
    def build(
        cls, products: DataFrame, limit: int = SEARCH_LIMIT, names: NameIndex | None = None
    ) -> Catalog:
        """From a stored product table; ``limit`` is the most products a request may ask for."""
        index = Lookup.stage(
            search_index(products, limit), ["segment", "store", "scale", "cell"], "search-index"
        )
        return cls(Lookup.over(products, ["product_id"]), index, names or NameIndex.build(products), limit)

    def traits(self, *columns: str | Column) -> Lookup:
        """Some columns of the products by id; the size of all of them is an upper bound."""
        return Lookup(self.products.df.select("product_id", *columns), ("product_id",), self.products.bytes)


def _catalog(given: Catalog | DataFrame, k: int = SEARCH_LIMIT) -> Catalog:
    if isinstance(given, DataFrame):
        return Catalog.build(given, k)
    if k > given.limit:
        raise ValueError(f"this catalog was built for {given.limit} products a request")
    return given


def batch_search(
    requests: DataFrame, products: Catalog | DataFrame, k: int = SEARCH_LIMIT
) -> DataFrame:
    """The ``k`` best products for every search request: ``request_id, rank`` and the product.

    Requests are first reduced to their distinct constraints. Those look up a small index of the
    catalog by equality (see :func:`search_index`), so no request is compared with every product.
    """
    catalog = _catalog(products, k)
    asked = with_constraints(
        requests.where(F.col("intent_type").isin(*SEARCH_INTENTS))
    ).select("request_id", "max_age", *_COMBO)
    combos = staged(asked.select("max_age", *_COMBO).distinct(), "constraints")
    index = catalog.index
    probes = combos.select(*_COMBO, F.explode(_cells_up_to("max_age")).alias("c")).select(
        *_COMBO, "c.*"
    )
    hits = lookup_join(probes, index, list(index.keys), "inner")
    allowed = (F.col("excluded") == "") | (F.col("franchise") != F.col("excluded"))
    best = top_per_key(hits.where(allowed), _COMBO, _order(), k).select(
        *_COMBO, "rank", "product_id"
    )
    described = [F.col(c).alias("in_segment" if c == "segment" else c) for c in SEARCH_COLUMNS[1:]]
    described = lookup_join(best, catalog.traits(*described), ["product_id"], "inner")
    listed = Lookup.stage(described, _COMBO, "search-results")
    return lookup_join(asked.select("request_id", *_COMBO), listed, _COMBO, "inner").select(
        "request_id",
        "rank",
        *[F.col("in_segment").alias(c) if c == "segment" else c for c in SEARCH_COLUMNS],
    )


def search_index(products: DataFrame, k: int) -> DataFrame:
    """For each segment, store option and age cell the products any request can need.

    A request takes the first ``k`` products of a fixed order after dropping one franchise and, then,
    the unknown ones. With at most ``k`` products per franchise kept, the first ``3k`` of a cell
    contain them. "At most an age" is a prefix of the age line, which is a union of few
    power-of-two cells, each one prepared here. The ages are cut down before they are spread
    over cells, so the index follows the number of different ages and not of products.
    """
    options = F.array(
        F.struct(F.lit("").alias("store"), F.lit(0).cast("bigint").alias("sold")),
        *[
            F.when(
                F.col(s) > 0,
                F.struct(F.lit(s).alias("store"), F.col(s).cast("bigint").alias("sold")),
            )
            for s in STORES
        ],
    )
    entries = (
        products.where(F.col("segment").isNotNull())
        .select(
            "segment",
            "franchise",
            F.col("min_age").cast("int").alias("min_age"),
            "popularity_global",
            "product_id",
            F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o"),
        )
        .select("*", "o.*")
        .drop("o")
    )
    by_age = _first(entries, ["segment", "store", "min_age"], k)
    spread = by_age.select("*", F.explode(_cells_of("min_age")).alias("c")).select(
        "*", "c.*"
    )
    return _first(spread, ["segment", "store", "scale", "cell"], k).drop("min_age", "c")


def _first(entries: DataFrame, group: list[str], k: int) -> DataFrame:
    per_franchise = top_per_key(entries, [*group, "franchise"], _order(), k)
    return top_per_key(per_franchise, group, _order(), 3 * k).drop("rank")


def _order() -> list[Column]:
    return [
        F.col("sold").desc(),
        F.col("popularity_global").desc(),
        F.col("product_id").asc(),
    ]


_ANYONE = f"named_struct('scale', {_ANY_AGE}, 'cell', 0L)"


def _cells_of(age: str) -> Column:
    """Cells an age lies in, one per scale, and the cell of requests without an age."""
    cell = f"named_struct('scale', s, 'cell', shiftright({age} + {_AGE_SHIFT}L, s))"
    return F.expr(
        f"""CASE WHEN {age} IS NULL THEN array({_ANYONE}) ELSE
            concat(array({_ANYONE}), transform(sequence(0, {_AGE_BITS}), s -> {cell})) END"""
    )


def _cells_up_to(age: str) -> Column:
    """Disjoint cells that cover exactly the ages up to the given one."""
    end = f"({age} + {_AGE_SHIFT + 1}L)"
    cell = f"named_struct('scale', s, 'cell', shiftright({end}, s) - 1)"
    return F.expr(
        f"""CASE WHEN {age} IS NULL THEN array({_ANYONE}) ELSE
            transform(filter(sequence(0, {_AGE_BITS}), s -> shiftright({end}, s) % 2 = 1),
                      s -> {cell}) END"""
    )


def filter_by_constraints(
    candidates: DataFrame, requests: DataFrame, products: Catalog | Lookup | DataFrame
) -> DataFrame:
    """Keep the ``(request_id, product_id)`` rows whose product meets the request."""
    if isinstance(products, Catalog):
        products = products.products
    elif isinstance(products, DataFrame):
        products = Lookup.over(products, ["product_id"])
    wanted = Lookup.stage(
        with_constraints(requests).select(
            "request_id", "segment", "store", "max_age", "excluded"
        ),
        ["request_id"],
        "request-constraints",
    )
    traits = products.df.select(
        "product_id",
        F.col("segment").alias("_segment"),
        F.col("min_age").alias("_min_age"),
        F.col("franchise").alias("_franchise"),
        *[F.col(s).alias(f"_{s}") for s in STORES],
    )
    traits = Lookup(traits, ("product_id",), products.bytes)
    in_store = F.col("store") == ""
    for s in STORES:
        in_store = in_store | ((F.col("store") == s) & (F.col(f"_{s}") > 0))
    meets = (
        (F.col("_segment") == F.col("segment"))
        & (F.col("max_age").isNull() | (F.col("_min_age") <= F.col("max_age")))
        & ((F.col("excluded") == "") | (F.col("_franchise") != F.col("excluded")))
        & in_store
    )
    described = lookup_join(candidates, traits, ["product_id"], "inner")
    joined = lookup_join(described, wanted, ["request_id"], "inner")
    return joined.where(meets).select(*candidates.columns)


def recommend(
    requests: DataFrame,
    products: Catalog | DataFrame,
    edges: DataFrame,
    k: int = SEARCH_LIMIT,
    neighbors: int = 5,
) -> DataFrame:
    """Recommendations: companions of the mentioned products first, then search results.

    Each mentioned name stands for the most popular product that contains it. Its ``neighbors``
    most frequent companions that meet the constraints come first, by their count; products found
    by the search follow in its order. A product is listed once. Returns ``request_id, rank,
    product_id, source``.
    """
    catalog = _catalog(products, k)
    searched = requests.where(F.col("intent_type").isin(*SEARCH_INTENTS))
    mentions = searched.select("request_id", F.explode("mentioned_products").alias("term"))
    meant = Lookup.stage(
        fuzzy_matches(mentions.select("term"), catalog.names, 1).select(
            "term", F.col("product_id").alias("product_id_1")
        ),
        ["term"],
        "mentions",
    )
    near = staged(
        edges.join(meant.df.select("product_id_1").distinct(), "product_id_1", "left_semi"), "near"
    )
    companions = Lookup.stage(
        neighbors_topk(near, catalog.products, neighbors).select(
            "product_id_1", "product_id", "cooccurrence_count"
        ),
        ["product_id_1"],
        "companions",
    )
    bought = lookup_join(
        lookup_join(mentions, meant, ["term"], "inner"), companions, ["product_id_1"], "inner"
    ).select("request_id", "product_id", "cooccurrence_count")
    together = filter_by_constraints(bought, searched, catalog).select(
        "request_id",
        "product_id",
        F.lit("bought together").alias("source"),
        F.lit(0).alias("tier"),
        (-F.col("cooccurrence_count")).cast("double").alias("place"),
    )
    found = batch_search(requests, catalog, k).select(
        "request_id",
        "product_id",
        F.lit("search").alias("source"),
        F.lit(1).alias("tier"),
        F.col("rank").cast("double").alias("place"),
    )
    best = F.min_by(
        F.struct("tier", "place", "source"), F.struct("tier", "place")
    ).alias("b")
    once = together.unionByName(found).groupBy("request_id", "product_id").agg(best)
    order = [F.col("b.tier").asc(), F.col("b.place").asc(), F.col("product_id").asc()]
    return top_per_key(once, ["request_id"], order, k).select(
        "request_id", "rank", "product_id", F.col("b.source").alias("source")
    )
