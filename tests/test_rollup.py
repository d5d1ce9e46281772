"""The rollup of the logs: what it answers, and which days a refresh touches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import querylog, rollup
from wayfold.sources.tables import append_logs

LOGS = (
    "timestamp timestamp, session_id string, query string, intent_type string, used_fallback boolean, "
    "products_returned int, response_time_ms double, llm_tokens_used int, success boolean"
)
START = dt.datetime(2024, 1, 30)


def rows(n, seed=1, days=4):
    rng = random.Random(seed)
    some = lambda x: x if rng.random() < 0.9 else None
    return [
        (
            START + dt.timedelta(seconds=rng.randrange(days * 86400)),
            some(f"s{rng.randrange(40)}"),
            f"q{rng.randrange(9)}",
            some(rng.choice("abc")),
            some(rng.random() < 0.3),
            some(rng.randrange(9)),
            some(rng.expovariate(0.01)),
            some(rng.randrange(900)),
            some(rng.random() < 0.8),
        )
        for _ in range(n)
    ]


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                found.setdefault(os.path.basename(folder), set()).add(name)
    return found


def same(got, expected):
    key = lambda r: [(x is not None, str(x)) for x in r[:1]]
    got, expected = sorted(map(tuple, got), key=key), sorted(map(tuple, expected), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, rel=1e-9), (a, b)


def test_answers_equal_those_of_the_logs(spark, tmp_path):
    logs_path, kept = str(tmp_path / "logs"), str(tmp_path / "rollup")
    whole = rows(900)
    for part in (whole[:500], whole[500:]):
        append_logs(spark.createDataFrame(part, LOGS), logs_path)
        rollup.refresh_rollup(spark, logs_path, kept, token_cap=500)
    logs, stored = spark.createDataFrame(whole, LOGS), spark.read.parquet(kept)
    same(rollup.stats(stored).collect(), querylog.log_stats(logs).collect())
    same(rollup.performance(stored).drop("sessions").collect(), querylog.performance_by(logs, "intent_type").collect())
    same(rollup.budget(stored, 0.2, 1.0).collect(), querylog.budget_flags(logs, 0.2, 1.0, 500).collect())
    sessions = {r["intent_type"]: r["sessions"] for r in rollup.performance(stored).collect()}
    exact = {r[0]: r[1] for r in logs.groupBy("intent_type").agg(F.count_distinct("session_id")).collect()}
    assert all(abs(sessions[k] - n) <= 1 for k, n in exact.items())


def test_a_late_row_updates_one_day(spark, tmp_path):
    logs_path, kept = str(tmp_path / "logs"), str(tmp_path / "rollup")
    append_logs(spark.createDataFrame(rows(300), LOGS), logs_path)
    assert len(rollup.refresh_rollup(spark, logs_path, kept)) == 4
    before = files(kept)
    assert rollup.refresh_rollup(spark, logs_path, kept) == [] and files(kept) == before
    late = [(START + dt.timedelta(days=1, hours=3), "late", "q", "late", True, 1, 1.0, 1, True)]
    append_logs(spark.createDataFrame(late, LOGS), logs_path)
    day = (START + dt.timedelta(days=1)).date()
    assert rollup.refresh_rollup(spark, logs_path, kept) == [day]
    after = files(kept)
    changed = f"day={day}"
    assert after[changed] != before[changed]
    assert {d: f for d, f in after.items() if d != changed} == {d: f for d, f in before.items() if d != changed}
    stored = spark.read.parquet(kept)
    assert rollup.stats(stored).first()["total_queries"] == 301
    assert rollup.percentiles(stored, {"p50": 0.5}).where("intent_type = 'late'").first()["p50"] == 1.0


def test_percentiles_stay_within_the_stated_error(spark):
    logs = spark.createDataFrame(rows(6000), LOGS).withColumn("day", F.to_date("timestamp"))
    levels = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = rollup.percentiles(rollup.rollup(logs), levels).collect()
    values = {}
    for r in logs.select("intent_type", "response_time_ms").collect():
        if r[1] is not None:
            values.setdefault(r[0], []).append(r[1])
    assert {r["intent_type"] for r in found} == set(values)
    for r in found:
        mine = values[r["intent_type"]]
        for name, level in levels.items():
            assert sum(v < r[name] for v in mine) / len(mine) <= level + rollup.RANK_ERROR
            assert sum(v <= r[name] for v in mine) / len(mine) >= level - rollup.RANK_ERROR


def test_no_logs_and_no_latencies(spark):
    empty = spark.createDataFrame([], LOGS).withColumn("day", F.to_date("timestamp"))
    assert tuple(rollup.stats(rollup.rollup(empty)).first()) == tuple(querylog.log_stats(empty).first())
    bare = [(START, None, "q", "a", None, None, None, None, None)]
    logs = spark.createDataFrame(bare, LOGS).withColumn("day", F.to_date("timestamp"))
    assert tuple(rollup.stats(rollup.rollup(logs)).first()) == tuple(querylog.log_stats(logs).first())
    assert rollup.percentiles(rollup.rollup(logs), {"p50": 0.5}).first()["p50"] is None
