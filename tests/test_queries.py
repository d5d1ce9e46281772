"""Registered queries against DuckDB, and the shape of their plans."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, database
from wayfold.operators.matching import match_levels
from wayfold.plans import model, stages
from wayfold.plans.registry import QUERIES
from wayfold.plans.scratch import staged

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Run here as in production; the other tests skip code generation to start faster."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) >= set(QUERIES)
    assert set(queries()) >= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_without_python_or_cross_join(spark, con, name):
    df = queries()[name](spark, FOLDER)
    text = plan(df)
    for node in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text, node
    assert compare(df, con, oracle_sql()[name]) == ""


def test_small_lookups_need_no_shuffle(spark):
    pairs = staged(model.place_pairs(spark, FOLDER), "test-pairs")
    text = plan(match_levels(pairs, stages.gazetteer(spark, FOLDER)))
    assert text.count("BroadcastHashJoin LeftOuter") >= 4
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["search_products_store"](spark, FOLDER))
    assert "EqualTo(segment,Games)" in text
    assert "LessThanOrEqual(min_age,7)" in text
    assert "TakeOrderedAndProject" in text
    text = plan(queries()["cooccurrence_baskets"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(queries()["neighbors_topk"](spark, FOLDER))
    assert text.count("WindowGroupLimit") >= 2
