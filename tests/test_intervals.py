"""Interval labels and range minima against ancestor chains."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import hierarchy as H
from wayfold.operators import intervals
from wayfold.operators import matching as M

NODES = "id long, parent_id long, position int, name string, admin_level int"


def random_nodes(seed, n, roots=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i < roots else rng.randrange(max(0, i - 12), i)
        # Levels need not grow down the tree; sibling positions may repeat.
        rows.append((i * 3, None if parent is None else parent * 3, rng.randint(0, 9), f"p{i}", rng.randint(1, 9)))
    rng.shuffle(rows)
    return rows


def chains(rows):
    by_id = {r[0]: r for r in rows}
    found = {}
    for i in by_id:
        chain, at = [], i
        while at is not None:
            chain.append(at)
            at = by_id[at][1]
        found[i] = chain
    return found


def level(rows, one, two):
    by_id, above = {r[0]: r for r in rows}, chains(rows)
    if one in above[two]:
        return by_id[one][4]
    if two in above[one]:
        return by_id[two][4]
    return max([2, *(by_id[i][4] for i in set(above[one]) & set(above[two]))])


@pytest.mark.parametrize("n, roots", [(1, 1), (2, 1), (60, 1), (64, 3), (65, 5)])
def test_levels_of_all_pairs(spark, n, roots):
    rows = random_nodes(n, n, roots)
    gaz = H.build_gazetteer(H.build_hierarchy(spark.createDataFrame(rows, NODES)))
    assert gaz.ranges is not None
    rng = random.Random(1)
    ids = [r[0] for r in rows]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(400)]
    frame = spark.createDataFrame(
        [(k, f"P{a // 3}", f"p{b // 3} ") for k, (a, b) in enumerate(pairs)], "k int, city_1 string, city_2 string"
    )
    got = {r["k"]: r["expected_level"] for r in M.match_levels(frame, gaz).collect()}
    assert got == {k: level(rows, a, b) for k, (a, b) in enumerate(pairs)}


def test_intervals_nest_like_the_tree(spark):
    rows = random_nodes(3, 80, 2)
    tree = H.build_hierarchy(spark.createDataFrame(rows, NODES))
    found = {r["id"]: (r["enter"], r["leave"]) for r in intervals.with_intervals(tree).collect()}
    assert sorted(e for e, _ in found.values()) == list(range(80))
    above = chains(rows)
    for one in found:
        for two in found:
            inside = found[one][0] <= found[two][0] < found[one][1]
            assert inside == (one in above[two])


def test_many_places_are_compared_by_their_chains(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_LABELLED", 10)
    rows = random_nodes(4, 40)
    gaz = H.build_gazetteer(H.build_hierarchy(spark.createDataFrame(rows, NODES)))
    assert gaz.ranges is None
    frame = spark.createDataFrame([(i, f"p{i}", f"p{39 - i}") for i in range(40)], "k int, city_1 string, city_2 string")
    got = {r["k"]: r["expected_level"] for r in M.match_levels(frame, gaz).collect()}
    assert got == {i: level(rows, 3 * i, 3 * (39 - i)) for i in range(40)}


def test_an_empty_tree_matches_nothing(spark):
    gaz = H.build_gazetteer(H.build_hierarchy(spark.createDataFrame([], NODES)))
    frame = spark.createDataFrame([("a", "b")], "city_1 string, city_2 string")
    row = M.match_levels(frame, gaz).first()
    assert (row["expected_level"], row["is_ambiguous"]) == (2, 0)


@pytest.mark.parametrize("depth", [1, 4, 5, 17])
def test_deep_trees_in_lazy_steps(spark, depth):
    rows = [(i, i - 1 if i else None, 0, f"d{i}", 2 + i) for i in range(depth)]
    tree = H.build_hierarchy(spark.createDataFrame(rows, NODES))
    found = {r["id"]: [a["id"] for a in r["ancestors"]] for r in tree.collect()}
    assert found == {i: list(range(i, -1, -1)) for i in range(depth)}
    assert tree.agg(F.max(F.size("path"))).first()[0] == depth
