"""Edges kept up to date, and shares from one scan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import catalog, edge_store
from wayfold.operators.cooccurrence import cooccurrence_from_baskets, solo_from_baskets
from wayfold.operators.querylog import intent_distribution, tool_opportunities

LINES = "basket int, item int"


def lines_of(baskets):
    return [(b, i) for b, items in baskets.items() for i in items]


def random_baskets(rng, numbers, items=30):
    return {b: [rng.randrange(items) for _ in range(rng.randint(1, 6))] for b in numbers}


def table(df):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}


def check(spark, root, baskets):
    lines = spark.createDataFrame(lines_of(baskets), LINES)
    edges = cooccurrence_from_baskets(lines, "basket", "item")
    assert table(edge_store.read(spark, root, edge_store.EDGES)) == table(edges)
    assert table(edge_store.read(spark, root, edge_store.SOLO)) == table(solo_from_baskets(lines, "basket", "item"))
    degrees = {}
    for (one, _), count in table(edges).items():
        n, total = degrees.get(one, (0, 0))
        degrees[one] = (n + 1, total + count)
    found = edge_store.read(spark, root, edge_store.DEGREES).collect()
    assert {r["item"]: (r["num_neighbors"], r["total_cooccurrence"]) for r in found} == degrees


def test_changes_equal_building_again(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "edges")
    baskets = random_baskets(rng, range(120))
    edge_store.create(spark.createDataFrame(lines_of(baskets), LINES), "basket", "item", root, 8)
    check(spark, root, baskets)
    for turn in range(3):
        gone = rng.sample(sorted(baskets), 40)
        withdrawn = {b: baskets[b] for b in gone}
        added = random_baskets(rng, [*gone[:20], *range(1000 * turn + 200, 1000 * turn + 210)])
        for b in gone:
            del baskets[b]
        baskets.update(added)
        edge_store.apply_changes(
            spark,
            root,
            spark.createDataFrame(lines_of(added), LINES),
            spark.createDataFrame(lines_of(withdrawn), LINES),
            "basket",
            "item",
            8,
        )
        check(spark, root, baskets)


def test_only_buckets_of_changed_products_are_written(spark, tmp_path):
    root = str(tmp_path / "edges")
    rng = random.Random(4)
    baskets = random_baskets(rng, range(300), 200)
    edge_store.create(spark.createDataFrame(lines_of(baskets), LINES), "basket", "item", root, 16)

    def files():
        return {
            folder: sorted(n for n in names if n.endswith(".parquet"))
            for folder, _, names in os.walk(f"{root}/edges")
            if "bucket=" in folder
        }

    before = files()
    none = spark.createDataFrame([], LINES)
    new = spark.createDataFrame([(5000, 7), (5000, 9)], LINES)
    edge_store.apply_changes(spark, root, new, none, "basket", "item", 16)
    after = files()
    assert sum(after[f] != before.get(f) for f in after) == 1
    baskets[5000] = [7, 9]
    check(spark, root, baskets)
    edge_store.apply_changes(spark, root, none, none, "basket", "item", 16)
    assert files() == after
    with pytest.raises(Exception, match="withdrawn"):
        edge_store.apply_changes(spark, root, none, spark.createDataFrame([(1, 9001), (1, 9002)], LINES), "basket", "item", 16)
    assert files() == after


def test_shares_read_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [(i, "abc"[i % 3] if i % 7 else None, i % 5, i % 4 == 0, f"{'xy'[i % 2]} q") for i in range(200)]
    spark.createDataFrame(rows, "id int, intent_type string, kind int, used_fallback boolean, query string").write.parquet(path)
    df = spark.read.parquet(path)
    found = intent_distribution(df)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == {
        k: (n, n / 200) for k, n in ((r[0], r[1]) for r in df.groupBy("intent_type").count().collect())
    }
    word = F.split_part("query", F.lit(" "), F.lit(1))
    some = tool_opportunities(df, word, 0.01)
    assert {r[0]: (r[1], r[2]) for r in some.collect()} == {"x": (50, 0.25)}
    sets = catalog.share_sets(df, "intent_type", "kind")
    for frame in (found, some, sets):
        plan = frame._jdf.queryExecution()
        frame.collect()
        assert "ReusedExchange" in plan.executedPlan().toString()
    got = {(r[2], r[0], r[1]): (r["products"], r["share"]) for r in sets.collect()}
    assert got[3, None, None] == (200, 1.0)
    by = {}
    for i, a, k, *_ in rows:
        for key in ((0, a, k), (1, a, None), (2, None, k)):
            by[key] = by.get(key, 0) + 1
    for (kind, a, k), n in by.items():
        parent = by[1, a, None] if kind == 0 else 200
        assert got[kind, a, k] == (n, n / parent)
    assert len(got) == len(by) + 1
    assert intent_distribution(df.limit(0)).count() == 0
