import pytest
from pyspark.sql import functions as F

from wayfold.operators import joins as J
from wayfold.plans.scratch import staged, staged_and_measured


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some are copies of one row, some have no key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 50 == 1, F.lit(None)).otherwise((i % 400).cast("string"))
    payload = F.when(i % 6 == 0, 0).otherwise(i)
    return staged(spark.range(6000).select(key.alias("k"), payload.alias("v")), "skewed")


@pytest.fixture(scope="module")
def table(spark):
    odd = spark.range(0, 400, 2).select(F.col("id").cast("string").alias("key"), "id")
    hot = spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "key string, id long")
    return staged(odd.unionByName(hot), "table")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_every_way_of_joining_gives_the_same(skewed, table, how, monkeypatch):
    lookup = J.Lookup.over(table, ["key"])
    plain = rows(skewed.join(table.withColumnRenamed("key", "k"), "k", how))
    assert rows(J.lookup_join(skewed, lookup, ["k"], how)) == plain
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    spread = J.lookup_join(skewed, lookup, ["k"], how)
    assert spread.columns == skewed.join(table.withColumnRenamed("key", "k"), "k", how).columns
    assert rows(spread) == plain


def test_hot_keys_are_found(skewed):
    (found,) = J.hot_keys(skewed, [["k"]])
    hot = skewed.where("k = 'hot'").select(J.key_hash(["k"])).first()[0]
    keys = {r["_wf_key"] for r in found.collect()}
    assert hot in keys and len(keys) <= J.HOT_KEYS


def test_hot_rows_are_spread(spark, skewed, table, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.lookup_join(skewed, J.Lookup.over(table, ["key"]), ["k"], "left")
        parts = joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_sizes_are_measured(spark, monkeypatch):
    df = spark.createDataFrame([("abc", 1, [1, 2]), (None, 2, None)], "s string, i int, a array<int>")
    table, count, size = staged_and_measured(df, "measured")
    assert count == 2
    assert size == J.measured_bytes(table) == (3 + 8 + 8 + len('{"a":[1,2]}')) + (8 + 8 + len("{}"))
    monkeypatch.setattr(J, "BROADCAST_BYTES", 10)
    assert J.measured_bytes(table) == 16
    assert staged_and_measured(df.limit(0), "empty")[1:] == (0, 0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from wayfold.plans import scratch

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session)


def test_user_columns_with_short_internal_names_survive(spark):
    left = spark.createDataFrame([(1, "a", 2, True)], "k int, _key string, _salt int, _hot boolean")
    right = spark.createDataFrame([(1, 9)], "k int, w int")
    found = J.spread_join(left, right, ["k"])
    assert found.columns == ["k", "_key", "_salt", "_hot", "w"]
    assert [tuple(r) for r in found.collect()] == [(1, "a", 2, True, 9)]
