"""Read administrative trees stored as nested JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.hierarchy import (
    Gazetteer,
    build_gazetteer,
    build_hierarchy,
)
from wayfold.operators.ids import assign_ids
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.plans.scratch import staged, staged_and_measured

# A child stays raw text until its own level is read, so documents are parsed level by level.
_NODE = "admin_level STRING, name STRING, children STRING"


def read_hierarchy_json(
    spark: SparkSession,
    path: str,
    root_name: str | dict[str, str],
    with_country: bool = False,
) -> DataFrame:
    """Node table of the trees under ``path``, ids from 0 in preorder.

    Each file holds one tree whose nodes have ``admin_level`` and ``children`` (name to node).
    ``root_name`` names the root, or maps file names to root names when there are several files.
    A node without a level is left out with its subtree; a level that is no number, a node that is no
    object and a document that cannot be read to its end are errors. A name given twice among siblings keeps
    its first position and last value. ``with_country`` adds the root's name as ``country``.

    A document is one row when read, which is inherent to nested JSON; from its second level on
    the subtrees are separate rows and are parsed in parallel.
    """
    file_name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    if isinstance(root_name, dict):
        names = F.create_map(*[F.lit(x) for kv in root_name.items() for x in kv])
        name = names[file_name]
    else:
        name = F.lit(root_name)
    roots = (
        spark.read.text(path, wholetext=True)
        .select(name.alias("name"), file_name.alias("file"), F.col("value").alias("raw"))
        .withColumn("node", _node(F.col("raw")))
    )
    # Several documents are ordered by file name.
    if isinstance(root_name, dict):
        order = F.array_position(
            F.array(*[F.lit(f) for f in sorted(root_name)]), F.col("file")
        ).cast("int")
    else:
        order = F.lit(0)
    level = _level(roots.withColumn("path", F.array(order)).withColumn("country", F.col("name")))
    levels = []
    while True:
        table, rows, _ = staged_and_measured(level, f"json-level-{len(levels)}")
        if not rows:
            break
        levels.append(table.drop("children"))
        level = _level(
            table.select(
                "path",
                "country",
                F.posexplode("children").alias("position", "child"),
            ).select(
                F.concat("path", F.array("position")).alias("path"),
                "country",
                F.col("child.key").alias("name"),
                _node(F.col("child.value")).alias("node"),
            )
        )
    nodes = reduce(DataFrame.unionByName, levels or [table.drop("children")])
    columns = ["id", "parent_id", "position", "name", "admin_level"]
    numbered = staged(assign_ids(nodes, [F.col("path").asc()], "id", start=0), "json-nodes")
    parents = Lookup.over(
        numbered.select(F.col("path").alias("above"), F.col("id").alias("parent_id")),
        ["above"],
    )
    linked = lookup_join(
        numbered.withColumn("above", F.slice("path", 1, F.size("path") - 1)),
        parents,
        ["above"],
    ).withColumn("position", F.element_at("path", -1))
    return linked.select(*columns, *(["country"] if with_country else []))


def _node(text: Column) -> Column:
    """A parsed node; NULL for NULL."""
    parsed = F.from_json(text, _NODE)
    broken = text.isNotNull() & F.json_object_keys(text).isNull()
    return F.when(broken, _unreadable("node", text)).otherwise(parsed)


def _unreadable(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unreadable {what}: "), F.substring(text, 1, 80)))


def _level(parsed: DataFrame) -> DataFrame:
    """Keep the nodes that have a level, with their children as ordered (name, text) entries."""
    own_name = F.when(F.col("name") != "", F.col("name")).otherwise(
        F.coalesce(F.col("node.name"), F.lit(""))
    )
    level, below = F.col("node.admin_level"), F.col("node.children")
    number = level.try_cast("double").cast("int")
    children = F.from_json(below, "MAP<STRING, STRING>")
    lost = below.isNotNull() & children.isNull()
    return parsed.where(level.isNotNull()).select(
        "path",
        "country",
        own_name.alias("name"),
        F.when(number.isNull(), _unreadable("level", level)).otherwise(number).alias("admin_level"),
        _last_of_each(
            F.map_entries(F.when(lost, _unreadable("children", below)).otherwise(children))
        ).alias("children"),
    )


def _last_of_each(entries: Column) -> Column:
    """Resolve repeated names among siblings: first position, last value."""
    names = F.transform(entries, lambda e: e["key"])
    distinct = F.array_distinct(names)

    def last(name: Column) -> Column:
        found = F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)
        return F.struct(name.alias("key"), found["value"].alias("value"))

    return F.when(F.size(distinct) == F.size(names), entries).otherwise(
        F.transform(distinct, last)
    )


def load_gazetteer(
    spark: SparkSession,
    path: str,
    root_name: str | dict[str, str],
    with_country: bool = False,
) -> Gazetteer:
    """From tree documents to a gazetteer ready for matching."""
    nodes = read_hierarchy_json(spark, path, root_name, with_country)
    return build_gazetteer(build_hierarchy(nodes))


def write_gazetteer(gaz: Gazetteer, root: str) -> None:
    """Store a gazetteer, so that later sessions need not build it."""
    gaz.nodes.write.parquet(f"{root}/nodes")
    gaz.by_city.df.write.parquet(f"{root}/by_city")
    gaz.by_city_state.df.write.parquet(f"{root}/by_city_state")
    if gaz.ranges is not None:
        gaz.ranges.write.parquet(f"{root}/ranges")


def read_gazetteer(spark: SparkSession, root: str) -> Gazetteer:
    """A gazetteer written by :func:`write_gazetteer`."""
    nodes = spark.read.parquet(f"{root}/nodes")
    extra = ["country"] if "country" in nodes.columns else []
    by_city = spark.read.parquet(f"{root}/by_city")
    by_city_state = spark.read.parquet(f"{root}/by_city_state")
    labelled = "enter" in by_city.schema["first"].dataType.names
    return Gazetteer(
        nodes,
        Lookup.over(by_city, [*extra, "name"]),
        Lookup.over(by_city_state, [*extra, "name", "state"]),
        bool(extra),
        spark.read.parquet(f"{root}/ranges") if labelled else None,
    )
