"""Exact near duplicates among vectors by dual traversal of cover trees.

Vectors of a label are dealt to roots of bounded size, by nearest pivot and then by hash. Each root is a cover tree
on the unit sphere: nested levels whose covering radius halves. Two vectors have at least the
wanted cosine when they are at most a certain distance apart, so a pair of nodes can be dropped when their centres are
farther apart than that distance and both covering radii together. What is left at the leaves is compared
by cosine in double precision.

Identical vectors are one member with a count, and pairs of roots return for each member its number of
links and one neighbour to be united with, so that no list of pairs leaves a task.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.components import connected_components
from wayfold.llm.tables import discard, release, stored

THRESHOLD = 0.98
# Members of a root, bytes of the vectors of a bundle of roots, and pivots for the whole table at most. All change the work only.
ROOT = 1024
BUNDLE_BYTES = 16 << 20
# Bundles of a label, if it has so many roots.
LEAST_RING = 4
MOST_PIVOTS = 4096
# The smallest covering radius that is halved further.
SMALLEST = 1e-6
# Room for rounding in bounds; the cosine itself is compared exactly.
SLACK = 1e-9
# Centre pairs whose distance is taken at once.
CHUNK = 1 << 18


@dataclass
class Level:
    """Nodes of one level: centre (a member), covering radius, parent in the level above."""

    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray


@dataclass
class CoverTree:
    """Unit vectors, levels from the root down, and the node of the last level each member is in."""

    units: np.ndarray
    levels: list[Level]
    leaf_of: np.ndarray


def build(units: np.ndarray) -> CoverTree:
    """Cover tree of the rows of ``units``.

    The root covers all. Each level halves the distance within which members are covered: a
    node keeps its centre (levels are nested) and members beyond the distance open new nodes.
    """
    n = len(units)
    reach = _distance(units, units[0])
    levels = [Level(np.zeros(1, int), np.array([reach.max()]), np.zeros(1, int))]
    node, away = np.zeros(n, dtype=int), reach
    cover = 2.0
    while levels[-1].radius.max() > SMALLEST and len(levels[-1].centre) < n:
        cover /= 2
        above = levels[-1]
        centres, parents = list(above.centre), list(range(len(above.centre)))
        # Members within the new distance stay with their centre.
        open_ones = away > cover
        for parent in np.unique(node[open_ones]).tolist():
            waiting = np.flatnonzero(open_ones & (node == parent))
            while len(waiting):
                first = waiting[0]
                apart = _distance(units[waiting], units[first])
                near = apart <= cover
                node[waiting[near]], away[waiting[near]] = len(centres), apart[near]
                centres.append(first)
                parents.append(parent)
                waiting = waiting[~near]
        radius = np.zeros(len(centres))
        np.maximum.at(radius, node, away)
        levels.append(Level(np.array(centres), radius, np.array(parents)))
    return CoverTree(units, levels, node)


def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def near_pairs(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of ``a`` and of ``b`` which may be within ``reach``; both orders when the trees are one."""
    first, second = np.zeros(1, int), np.zeros(1, int)
    deep = max(len(a.levels), len(b.levels))
    for depth in range(deep):
        x, y = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        if depth:
            first, second = _expand(a, depth, first, x), _expand(b, depth, second, y)
            first, second = _product(first, second)
        keep = _within(a, b, x, y, first, second, reach)
        first, second = first[keep], second[keep]
        if not len(first):
            return first, second
    return _product(_members(a, first), _members(b, second))


def _expand(tree: CoverTree, depth: int, nodes: np.ndarray, level: Level) -> list[np.ndarray]:
    """Children of each node, as (start, count) into an order; a tree that has ended stays."""
    if depth >= len(tree.levels):
        return [nodes, np.ones(len(nodes), int), np.arange(len(level.centre))]
    order = np.argsort(level.parent, kind="stable")
    counts = np.bincount(level.parent, minlength=len(tree.levels[depth - 1].centre))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return [starts[nodes], counts[nodes], order]


def _members(tree: CoverTree, nodes: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(tree.leaf_of, kind="stable")
    counts = np.bincount(tree.leaf_of, minlength=len(tree.levels[-1].centre))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return [starts[nodes], counts[nodes], order]


def _product(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of nodes, all pairs of what they hold."""
    (xs, xn, xo), (ys, yn, yo) = x, y
    sizes = xn * yn
    at = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return xo[xs[at] + inner // yn[at]], yo[ys[at] + inner % yn[at]]


def _within(
    a: CoverTree,
    b: CoverTree,
    x: Level,
    y: Level,
    first: np.ndarray,
    second: np.ndarray,
    reach: float,
) -> np.ndarray:
    """Whether the covering radii leave a chance for each pair of nodes."""
    limit = reach + x.radius[first] + y.radius[second] + SLACK
    if len(first) * 4 > len(x.centre) * len(y.centre):
        dots = (a.units[x.centre] @ b.units[y.centre].T)[first, second]
    else:
        dots = np.concatenate(
            [
                np.einsum(
                    "ij,ij->i",
                    a.units[x.centre[first[i : i + CHUNK]]],
                    b.units[y.centre[second[i : i + CHUNK]]],
                )
                for i in range(0, len(first), CHUNK)
            ]
        )
    return np.sqrt(np.maximum(2 - 2 * dots, 0)) <= limit


def exact_links(
    a: CoverTree, va: np.ndarray, b: CoverTree, vb: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members whose cosine reaches the threshold, from original vectors."""
    reach = math.sqrt(2 - 2 * threshold)
    first, second = near_pairs(a, b, reach)
    if a is b:
        upper = first < second
        first, second = first[upper], second[upper]
    va, vb = _scaled(va), _scaled(vb)
    na, nb = np.sqrt((va * va).sum(axis=1)), np.sqrt((vb * vb).sum(axis=1))
    keep = np.zeros(len(first), dtype=bool)
    for i in range(0, len(first), CHUNK):
        f, s = first[i : i + CHUNK], second[i : i + CHUNK]
        cosine = np.einsum("ij,ij->i", va[f], vb[s]) / (na[f] * nb[s])
        keep[i : i + CHUNK] = cosine >= threshold
    return first[keep], second[keep]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is between a half and one.

    This rounds nothing and leaves the cosine as it is, but squares neither overflow nor vanish.
    """
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None])


def _smallest_of_group(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest one reachable by the links."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[first], label[second])
        following = label.copy()
        np.minimum.at(following, first, least)
        np.minimum.at(following, second, least)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def usable(vector: str) -> Column:
    """Whether a vector has only finite components, none null, and is not zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & some, F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Id, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Vectors of one label (null is none) and one length link when their cosine reaches ``threshold``.
    Null, empty and zero vectors and those with null or non-finite components link with nothing, and
    rows with a null id take no part (their component and ``kept`` are null). Each row gives one
    row: rows that repeat an id are vectors of their own. Other columns are left out.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        usable(vector_col).alias("usable"),
    )
    joins = F.col("usable") & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("usable", joins).withColumns(
        {
            "h": F.when(F.col("usable"), F.xxhash64("label", "vector")),
            "g": F.when(F.col("usable"), F.xxhash64(F.lit("second"), "label", "vector")),
        }
    )
    different = (
        rows.where("usable")
        .groupBy("h", "g")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("rep"),
            F.min(F.struct("label", "vector")).alias("v"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"),
            "h",
            "g",
            "copies",
            "rep",
            "v.label",
            "v.vector",
            F.size("v.vector").alias("dim"),
        )
    )
    nodes = _celled(stored(different, "vectors"))
    links = _root_links(nodes, threshold)
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    united = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = nodes.drop("vector", "cell").join(united, "node", "left").join(counts, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = stored(
        labelled.join(smallest, "component").select(
            "h", "g", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")
        ),
        "vector-labels",
    )
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return (
        rows.select("id", "h", "g")
        .join(found, ["h", "g"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            alone.alias("component_id"),
        )
        .withColumn("kept", F.col(f"`{id_col}`") == F.col("component_id"))
    )


def _celled(nodes: DataFrame) -> DataFrame:
    """Stored nodes, dropped here, with the ``cell`` of the nearest pivot. Stored."""
    spark = nodes.sparkSession
    total = nodes.count()
    wanted = min(MOST_PIVOTS, -(-total // ROOT))
    # Pivots: a bounded choice by hash, of which each label has its share.
    pivots: dict = {}
    for row in nodes.orderBy(F.xxhash64("node")).limit(wanted).select("label", "dim", "vector").collect():
        pivots.setdefault((str(row["label"]), row["dim"]), []).append(row["vector"])
    shipped = spark.sparkContext.broadcast(
        {k: _units(np.array(v, dtype=float)) for k, v in pivots.items()}
    )

    @F.pandas_udf("int")
    def nearest(label: pd.Series, dim: pd.Series, vector: pd.Series) -> pd.Series:
        found = np.zeros(len(label), dtype=np.int32)
        keys = pd.Series(list(zip(label.astype(str), dim)), dtype=object)
        for key, at in keys.groupby(keys).groups.items():
            centres = shipped.value.get(key)
            if centres is not None and len(centres) > 1:
                own = _units(np.stack(vector.iloc[at].to_list()).astype(float))
                found[at] = (own @ centres.T).argmax(axis=1)
        return pd.Series(found)

    celled = nodes.withColumn("cell", nearest(F.col("label").cast("string"), "dim", "vector"))
    celled = stored(celled, "cells")
    discard(spark, nodes)
    return celled


def _root_links(celled: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``n`` links found in one pair of roots, and ``other``, a node it is united with. Stored.

    Roots travel in bundles. Bundles of a label stand in a ring, and each meets the one so many steps ahead, a step more in
    each turn, so no turn needs more than two copies of a root.
    """
    spark = celled.sparkSession
    cells = celled.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count(F.lit(1)) / ROOT).alias("parts")
    )
    dealt = celled.select("node", "copies", "label", "dim", "vector", "cell").join(cells, ["label", "dim", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts"))
    )

    def plant(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        values = np.stack(group["vector"].to_list()).astype(float)
        tree = build(_units(values))
        # Units are made again from the vectors, which are kept in single precision if that holds them.
        single = values.astype("f4") if np.abs(values).max() < np.finfo("f4").max else values
        held = (
            group["node"].to_numpy(), group["copies"].to_numpy(), single if (single == values).all() else values,
            [[x.astype("i4") for x in (level.centre, level.parent)] + [level.radius] for level in tree.levels],
            tree.leaf_of.astype("i4"),
        )
        return pd.DataFrame(
            {
                "label": [key[0]],
                "dim": [key[1]],
                "root": [int(group["node"].iloc[0])],
                "members": [len(group)],
                "centre": [tree.units[0]],
                "radius": [float(tree.levels[0].radius[0])],
                "held": [pickle.dumps(held)],
            }
        )

    label_type = celled.schema["label"].dataType.simpleString()
    schema = f"label {label_type}, dim int, root long, members int, centre array<double>, radius double, held binary"
    roots = stored(
        dealt.groupBy("label", "dim", "cell", "part").applyInPandas(plant, schema), "roots"
    )
    # The shuffle of all vectors.
    release(spark)
    # Roots in an order of their own, as many to a bundle as fit: a few numbers for each root.
    label = Window.partitionBy("label", "dim")
    before = label.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("members").cast("long") * F.col("dim") * 8
    most = F.least(F.lit(float(BUNDLE_BYTES)), F.sum(size).over(label) / LEAST_RING)
    filled = F.coalesce(F.sum(size).over(before), F.lit(0))
    bundled = stored(
        roots.select("label", "dim", "root", F.floor(filled / most).cast("int").alias("bundle")), "bundles"
    )
    # Bundles may be left out by the size of a root, so they are numbered without gaps.
    numbers = bundled.select("label", "dim", "bundle").distinct().withColumns(
        {
            "place": F.row_number().over(Window.partitionBy("label", "dim").orderBy("bundle")) - 1,
            "ring": F.count(F.lit(1)).over(Window.partitionBy("label", "dim")).cast("int"),
        }
    )
    ringed = stored(bundled.join(numbers, ["label", "dim", "bundle"]).drop("bundle"), "rings")
    discard(spark, bundled)
    reach = math.sqrt(2 - 2 * threshold)
    longest = ringed.agg(F.max("ring")).first()[0] or 0
    found = []
    for step in range(max(1, longest // 2 + 1)):
        found.append(stored(_ring_links(roots, ringed, step, reach, threshold), "vector-links"))
        release(spark)
    for done in (roots, ringed):
        discard(spark, done)
    return reduce(DataFrame.union, found)


def _ring_links(roots: DataFrame, ringed: DataFrame, step: int, reach: float, threshold: float) -> DataFrame:
    """Links between the roots of bundles that are so many steps apart on the ring of their label."""
    sides = F.array(F.col("place"), F.pmod(F.col("place") - step, F.col("ring")))
    # Half a ring ahead is half a ring behind, so only one of the two is taken.
    taken = F.filter(sides, lambda a: (F.lit(2 * step) < F.col("ring")) | (F.lit(2 * step) == F.col("ring")) & (a < step))
    meeting = ringed.select("label", "dim", "root", "place", "ring", F.explode(F.array_distinct(taken)).alias("pair"))
    ends = meeting.select("label", "dim", "pair", F.col("root"), (F.col("place") == F.col("pair")).alias("ahead"))
    carried = ends.join(roots.select("root", "centre", "radius", "held"), "root")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("root")
        centres = np.stack(group["centre"].to_list()).astype(float)
        radius, sides = group["radius"].to_numpy(), group["ahead"].to_numpy()
        held: dict[int, tuple] = {}

        def opened(i: int) -> tuple:
            if i not in held:
                ids, copies, values, levels, leaf_of = pickle.loads(group["held"].iloc[i])
                values = values.astype(float)
                levels = [Level(c.astype(int), r, p.astype(int)) for c, p, r in levels]
                held[i] = (ids, copies, values, CoverTree(_units(values), levels, leaf_of.astype(int)))
            return held[i]

        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for i in range(len(group)):
            gaps = np.sqrt(((centres[i:] - centres[i]) ** 2).sum(axis=1))
            for j in (i + np.flatnonzero(gaps <= radius[i:] + radius[i] + reach + 2 * SLACK)).tolist():
                # Roots of one bundle have met in the first turn.
                if not step or sides[i] != sides[j]:
                    for column, x in zip(out, _pair_links(opened(i), opened(j), i == j, threshold)):
                        column.append(x)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("node", "n", "other"), out)})

    return carried.groupBy("label", "dim", "pair").applyInPandas(meet, "node long, n long, other long")


def _pair_links(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of two roots with links, how many, and a member each is united with."""
    (ids, copies, values, tree), (ids2, copies2, values2, tree2) = a, b
    first, second = exact_links(tree, values, tree2, values2, threshold)
    if same:
        every, weight = ids, copies
    else:
        every, weight = np.concatenate([ids, ids2]), np.concatenate([copies, copies2])
        second = second + len(ids)
    n = np.bincount(first, weight[second], len(every)) + np.bincount(second, weight[first], len(every))
    smallest = _smallest_of_group(len(every), first, second)
    some = n > 0
    return every[some], n[some].astype(np.int64), every[smallest[some]]


def _units(values: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish.
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))
