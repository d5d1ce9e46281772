"""Administrative trees: ancestor closure, name lookups, statistics.

Node tables have the columns ``id, parent_id, position, name, admin_level``: ids are unique, and
``position`` is the place among the siblings in document order. :func:`build_hierarchy` turns one into a
hierarchy: ``id, path, name, original_name, admin_level, parent_id, ancestors``. ``path`` holds the
sibling positions from the root; arrays compare element by element, so ordering by it is preorder.
A ``country`` column, when present, is carried along and separates the lookups.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.functions.text import normalize_name
from wayfold.operators import joins
from wayfold.operators.intervals import range_minima, with_intervals
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.plans.scratch import staged, staged_and_measured

# Places up to which their range minima, 8 bytes times the logarithm for each, go to every task.
MOST_LABELLED = 1 << 16
# Steps of pointer doubling taken before a small tree is looked at again.
LAZY_STEPS = 2


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("country",) if c in df.columns]


def build_hierarchy(nodes: DataFrame) -> DataFrame:
    """Ancestor chains of a node table, by pointer doubling.

    Every node holds a piece of its chain and points at the node above that piece; a round appends
    the piece found there, so the pieces double and a tree of depth ``d`` takes ``log2(d)`` joins. Rounds
    are written out, those of a small tree a few at a time, so a lost executor costs little of the walk.

    A node without a level is dropped together with everything below it. A parent that is not in the
    table and a node that is its own ancestor are errors.
    """
    own = F.struct(
        F.col("id").alias("id"), F.col("name").alias("name"), F.col("admin_level").alias("level")
    )
    chains = (
        nodes.select(
            F.col("id").cast("long").alias("id"),
            F.array(F.col("position").cast("int")).alias("path"),
            normalize_name("name").alias("name"),
            F.col("name").alias("original_name"),
            F.col("admin_level").cast("int").alias("admin_level"),
            F.col("parent_id").cast("long").alias("parent_id"),
            *[normalize_name(c).alias(c) for c in _carried(nodes)],
        )
        .withColumn("ancestors", F.array(own))
        .withColumn("up", F.col("parent_id"))
    )
    table, _, size = staged_and_measured(chains, "nodes")
    while True:
        # A small tree is doubled several times at once: a stored step takes longer than it saves.
        for _ in range(LAZY_STEPS if size <= joins.BROADCAST_BYTES else 1):
            table = _doubled(table, size)
        seen = Observation()
        table, _, size = staged_and_measured(table.observe(seen, F.count("up").alias("pending")), "chains")
        if not seen.get["pending"]:
            break
    levels = F.transform("ancestors", lambda a: a["level"].isNotNull())
    whole = table.where(F.forall(levels, lambda known: known))
    return whole.select(
        "id",
        "path",
        "name",
        "original_name",
        "admin_level",
        "parent_id",
        "ancestors",
        *_carried(nodes),
    )


def _doubled(table: DataFrame, size: int) -> DataFrame:
    """One step of pointer doubling."""
    above = table.select(
        F.col("id").alias("up"),
        F.col("path").alias("above_path"),
        F.col("ancestors").alias("above_chain"),
        F.col("up").alias("next"),
    )
    longer = (
        lookup_join(table.where(F.col("up").isNotNull()), Lookup(above, ("up",), size), ["up"])
        .withColumn("path", F.concat("above_path", "path"))
        .withColumn("ancestors", F.concat("ancestors", _sound_chain()))
        .withColumn("up", F.col("next"))
    )
    return table.where(F.col("up").isNull()).unionByName(longer.select(*table.columns))


def _sound_chain() -> Column:
    """The piece of chain found above, or an error where there is none or the node is in it."""
    absent = F.concat(
        F.lit("node "), F.col("id"), F.lit(" lies below an absent node "), F.col("up")
    )
    loop = F.concat(F.lit("node "), F.col("id"), F.lit(" is its own ancestor"))
    chain = F.col("above_chain")
    return (
        F.when(chain.isNull(), F.raise_error(absent))
        .when(F.exists(chain, lambda a: a["id"] == F.col("id")), F.raise_error(loop))
        .otherwise(chain)
    )


@dataclass(frozen=True)
class Gazetteer:
    """A hierarchy with its two name lookups, each holding one row per key.

    ``ranges`` is the one-row table by which labelled places are compared; without it the lookups hold
    places with their ancestor chains.
    """

    nodes: DataFrame
    by_city: Lookup
    by_city_state: Lookup
    has_country: bool
    ranges: DataFrame | None = None


def build_gazetteer(hierarchy: DataFrame) -> Gazetteer:
    """Stage the lookups of a stored hierarchy.

    A lookup row holds the number of places with that key and the first of them in document
    order, never the whole list, so a very common name costs one row and joins never fan out. Places are
    labelled by intervals while the table of range minima is small enough to go to every task.
    """
    extra = _carried(hierarchy)
    places = hierarchy.count()
    labelled = 0 < places <= MOST_LABELLED
    nodes = with_intervals(hierarchy) if labelled else hierarchy
    # Rows without a state are the lookup by name alone; both come from one pass.
    states = F.concat(F.array(F.lit(None).cast("string")), ancestor_names())
    by_name = (
        nodes.select("*", F.explode(states).alias("state"))
        .groupBy(*extra, "name", "state")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(place(labelled), F.col("path")).alias("first"))
    )
    # The two tables do not depend on each other.
    with ThreadPoolExecutor(2) as pool:
        ranges = pool.submit(lambda: staged(range_minima(hierarchy, places), "ranges") if labelled else None)
        names, _, size = pool.submit(staged_and_measured, by_name, "place-names").result()
        ranges = ranges.result()
    alone, within = names.where("state is null").drop("state"), names.where("state is not null")

    def lookup(table: DataFrame, keys: list[str]) -> Lookup:
        if size <= joins.BROADCAST_BYTES:
            return Lookup(table, tuple(keys), size)
        return Lookup.over(table, keys)

    return Gazetteer(
        hierarchy,
        lookup(alone, [*extra, "name"]),
        lookup(within, [*extra, "name", "state"]),
        bool(extra),
        ranges,
    )


def ancestor_names() -> Column:
    """Distinct names of the proper ancestors."""
    proper = F.slice("ancestors", F.lit(2), F.size("ancestors"))
    return F.array_distinct(F.transform(proper, lambda a: a["name"]))


def place(labelled: bool) -> Column:
    """What a lookup knows of a place: its interval or, where there is none, its ancestor chain."""
    known = [F.col("id").alias("id"), F.col("admin_level").alias("level")]
    if labelled:
        return F.struct(*known, "enter", "leave")
    chain = F.transform("ancestors", lambda a: F.struct(a["id"].alias("id"), a["level"].alias("level")))
    return F.struct(*known, chain.alias("ancestors"))


def hierarchy_totals(hierarchy: DataFrame) -> DataFrame:
    """Places, distinct names and distinct (name, ancestor name) pairs as one row."""
    names = hierarchy.agg(
        F.count(F.lit(1)).alias("total_locations"),
        F.count_distinct("name").alias("unique_cities"),
    )
    pairs = (
        hierarchy.select("name", F.explode(ancestor_names()).alias("state"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
    return names.withColumn("unique_city_state_pairs", pairs.scalar())


def level_histogram(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.groupBy("admin_level").agg(F.count(F.lit(1)).alias("locations"))


def children_counts(hierarchy: DataFrame) -> DataFrame:
    """Direct children of every place that has any."""
    return (
        hierarchy.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("children"))
    )


def _folded(name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return normalize_name(f"'{quoted}'")


def locations_named(hierarchy: DataFrame, name: str) -> DataFrame:
    """All places with a name, in document order."""
    return hierarchy.where(F.col("name") == _folded(name)).orderBy("path")


def containment_pairs(
    hierarchy: DataFrame, inner: str | None = None, outer: str | None = None
) -> DataFrame:
    """Every (place, place that contains it), optionally for given names only.

    The ancestor chain already names the containers, so no join is needed.
    """
    places = hierarchy
    if inner is not None:
        places = places.where(F.col("name") == _folded(inner))
    proper = F.slice("ancestors", F.lit(2), F.size("ancestors"))
    pairs = places.select(
        F.col("id").alias("inner_id"),
        F.col("name").alias("inner_name"),
        F.explode(proper).alias("a"),
    ).select(
        "inner_id",
        "inner_name",
        F.col("a.id").alias("outer_id"),
        F.col("a.name").alias("outer_name"),
        F.col("a.level").alias("outer_level"),
    )
    if outer is not None:
        pairs = pairs.where(F.col("outer_name") == _folded(outer))
    return pairs
