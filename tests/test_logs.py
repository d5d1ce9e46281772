import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import percentiles as P
from wayfold.operators import querylog as L
from wayfold.sources.tables import (
    FEEDBACK_SCHEMA,
    LOG_SCHEMA,
    append_log_stream,
    append_logs,
    validate_feedback,
)
from wayfold.streaming.logs import log_metrics, match_stream

DAY = dt.datetime(2024, 1, 1)


def log(minute, session="s", intent="search", tools=(), fallback=False, ms=100.0, ok=True, tokens=50, products=0, query="q"):
    return (
        DAY + dt.timedelta(minutes=minute),
        session,
        query,
        intent,
        list(tools),
        {t: "{}" for t in tools},
        fallback,
        products,
        ms,
        tokens,
        ok,
    )


def test_totals_of_two_logs(spark):
    logs = spark.createDataFrame(
        [log(0, tools=["search_products"], ms=245.5, products=5), log(1, ms=120.0)], LOG_SCHEMA
    )
    assert tuple(L.log_stats(logs).first()) == (2, 1.0, 182.75, 2.5, 0.0)
    assert [tuple(r) for r in L.tool_usage(logs).collect()] == [("search_products", 1)]
    empty = L.log_stats(logs.limit(0)).first()
    assert empty["total_queries"] == 0 and empty["success_rate"] is None


def test_fallbacks_opportunities_and_budget(spark):
    rows = [log(i, fallback=i < 4, query="a b" if i < 3 else f"x {i}", ok=i != 9, tokens=1000 * i) for i in range(10)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    assert [tuple(r) for r in L.fallback_queries(logs, 1).collect()] == [("a b", 3)]
    assert [tuple(r) for r in L.failed_queries(logs).collect()] == [("x 9", 1)]
    found = L.tool_opportunities(logs, F.split_part("query", F.lit(" "), F.lit(1)), 0.2)
    assert [tuple(r) for r in found.collect()] == [("a", 3, 0.3)]
    month = L.budget_flags(logs, 10.0).first()
    assert tuple(month) == ("2024-01", 10, 45000, 5, 450.0, True)
    assert not L.budget_flags(logs, 8.0).first()["alert"]


def test_rate_limits(spark):
    rows = [log(0, "a") for _ in range(11)] + [log(i, "b") for i in range(101)] + [log(0, "c")] * 11
    tiers = spark.createDataFrame([("a", "free"), ("c", "premium")], "session_id string, tier string")
    got = L.rate_limit_breaches(spark.createDataFrame(rows, LOG_SCHEMA), "session_id", tiers)
    assert sorted((r["session_id"], r["period"], r["calls"], r["allowed"]) for r in got.collect()) == [
        ("a", "minute", 11, 10),
        ("b", "day", 101, 100),
    ]


def test_last_accepted_feedback_wins(spark):
    logs = spark.createDataFrame([log(0), log(1), log(2)], LOG_SCHEMA)

    def rated(minute, hour, rating, product=None):
        at = DAY + dt.timedelta(minutes=minute)
        return (at, "s", at + dt.timedelta(hours=hour), rating, product)

    feedback = spark.createDataFrame(
        [rated(0, 1, 3, 7), rated(0, 2, 5, 8), rated(0, 3, 6, 9), rated(1, 1, 0)], FEEDBACK_SCHEMA
    )
    got = L.apply_feedback(logs, feedback).orderBy("timestamp").collect()
    assert [(r["user_feedback"], r["user_clicked_product"]) for r in got] == [(5, 8), (None, None), (None, None)]
    accepted, rejected = validate_feedback(feedback)
    assert (accepted.count(), rejected.count()) == (2, 2)


def test_requests_are_validated(spark):
    texts = ["fine", "x" * 500, "x" * 501, "please Drop it", "raindrops", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, query string")
    got = [r["rejected_for"] for r in L.validate_requests(df).orderBy("i").collect()]
    assert got == [None, None, "too long", "suspicious", "suspicious", None]


def test_arguments_and_serialised_logs(spark):
    calls = spark.createDataFrame(
        [(1, 0, "s", "a"), (1, 1, "d", "b"), (1, 2, "s", "c")], "log_id long, seq int, tool string, args string"
    )
    assert L.tool_arguments(calls).first()["tool_arguments"] == {"s": "c", "d": "b"}
    rows = [log(0, tools=["t"]), (DAY + dt.timedelta(microseconds=5), *log(0)[1:])]
    out = L.logs_to_json(spark.createDataFrame(rows, LOG_SCHEMA)).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in out] == ["2024-01-01T00:00:00", "2024-01-01T00:00:00.000005"]
    assert (out[0]["tools_called"], out[0]["tool_arguments"]) == ('["t"]', '{"t":"{}"}')


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    groups = {
        "big": [round(rng.expovariate(0.01), 1) for _ in range(12000)],
        **{f"size {n}": [float(rng.randrange(10 * n)) for _ in range(n)] for n in (2, 3, 7, 99, 1001)},
        "equal": [3.0] * 5000,
        "few": [5.0, 1.0, 2.0, 9.0],
        "one": [4.0],
        None: [1.0, 2.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("few", None), ("few", float("nan"))]
    levels = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in P.exact_percentiles(df, "g", "v", levels).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, q in levels.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q)), (g, name)


def test_stream_gives_the_closed_windows_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [log(rng.randrange(60), intent=rng.choice("ab"), ms=float(i), ok=i % 3 > 0) for i in range(80)]
    source = str(tmp_path / "in")
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    logs.coalesce(1).write.parquet(source)
    # A far later row closes all windows of the first file.
    spark.createDataFrame([log(9999)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        log_metrics(stream)
        .writeStream.format("memory")
        .queryName("metrics")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("metrics").collect()}
    expected = {tuple(r) for r in log_metrics(logs).collect()}
    assert got == expected


def test_logs_are_appended_by_day(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = spark.createDataFrame([log(0), log(60 * 24)], LOG_SCHEMA)
    append_logs(logs, path)
    append_logs(logs, path)
    assert spark.read.parquet(path).groupBy("day").count().count() == 2
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(path)
    out = str(tmp_path / "copy")
    append_log_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_pairs_are_matched_in_a_stream(spark, tmp_path):
    from wayfold.operators.hierarchy import build_gazetteer, build_hierarchy

    rows = [(1, None, 0, "r", 2), (2, 1, 0, "a", 6), (3, 2, 0, "t", 8)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, position int, name string, admin_level int")
    gaz = build_gazetteer(build_hierarchy(nodes))
    schema = "id_1 int, city_1 string, state_1 string, city_2 string, state_2 string"
    source = str(tmp_path / "pairs")
    spark.createDataFrame([(1, "T", "a", "a", None)], schema).write.parquet(source)
    query = (
        match_stream(spark.readStream.schema(schema).parquet(source), gaz)
        .writeStream.format("memory")
        .queryName("matched")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [tuple(r)[-2:] for r in spark.table("matched").collect()] == [(6, 0)]


def test_equal_times_have_a_fixed_order(spark):
    from wayfold.operators.querylog import latest_feedback, latest_logs

    logs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "timestamp long, session_id string")
    assert [r["session_id"] for r in latest_logs(logs, 2).collect()] == ["a", "b"]
    ratings = [(1, "s", 2, 7, 5), (1, "s", 4, 3, 5), (1, "s", 3, 9, 4)]
    schema = "timestamp long, session_id string, rating int, product_id long, rated_at long"
    last = latest_feedback(spark.createDataFrame(ratings, schema)).first()
    assert (last["user_feedback"], last["user_clicked_product"]) == (4, 3)
