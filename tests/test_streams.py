"""Sliding limits, window percentiles, logs written once, and feedback merged into stored days."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import rollup
from wayfold.sources import tables as S
from wayfold.streaming.limits import rate_breaches
from wayfold.streaming.logs import window_percentiles

DAY = dt.datetime(2024, 1, 1)
CALLS = "user string, at timestamp, more int"


def written(stream, tmp_path, name):
    """What a stream writes until it has read all there is."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_sliding_limits_equal_counting_back(spark, tmp_path):
    rng = random.Random(2)
    seconds = [(f"u{rng.randrange(6)}", rng.randrange(200_000)) for _ in range(400)]
    # One user makes a third of the calls, some of them at one time.
    seconds += [("hot", 50_000 + 7 * (i // 2)) for i in range(200)]
    rows = [(u, DAY + dt.timedelta(seconds=s), 1) for u, s in seconds]
    rows.sort(key=lambda r: r[1])
    # Files in the order of time, rows of a file not.
    source = str(tmp_path / "calls")
    for k in range(0, len(rows), 150):
        part = rows[k : k + 150]
        rng.shuffle(part)
        spark.createDataFrame(part + [(None, DAY, 1), ("u0", None, 1)], CALLS).coalesce(1).write.mode("append").parquet(source)
    # A row without user lets time pass, too.
    end = [(None, DAY + dt.timedelta(days=9), 1)]
    spark.createDataFrame(end, CALLS).coalesce(1).write.mode("append").parquet(source)
    names = sorted((f for f in os.listdir(source) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{source}/{f}"))
    for k, name in enumerate(names):
        os.utime(f"{source}/{name}", (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = written(rate_breaches(stream, "user", {"minute": 2, "day": 9}, "at"), tmp_path, "breaches").collect()
    expected = []
    for user in {u for u, _ in seconds}:
        mine = sorted(s for u, s in seconds if u == user)
        for period, length, allowed in (("minute", 60, 2), ("day", 86_400, 9)):
            for i in range(allowed, len(mine)):
                if mine[i] - mine[i - allowed] < length:
                    expected.append((user, period, DAY + dt.timedelta(seconds=mine[i]), allowed))
    assert sorted(map(tuple, found)) == sorted(expected) and len(expected) > 100
    with pytest.raises(ValueError):
        rate_breaches(stream, "user", {"hour": 2}, "at")


def test_window_percentiles_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (DAY + dt.timedelta(seconds=rng.randrange(7200)), rng.choice("ab"), rng.expovariate(0.1) if rng.random() < 0.9 else None)
        for _ in range(3000)
    ]
    rows.append((DAY + dt.timedelta(seconds=10), "none", None))
    closing = [(DAY + dt.timedelta(days=3), "z", 1.0)]
    schema = "timestamp timestamp, intent_type string, response_time_ms double"
    source = str(tmp_path / "logs")
    spark.createDataFrame(rows + closing, schema).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    levels = {"p50": 0.5, "p95": 0.95}
    found = written(window_percentiles(stream, levels, "1 hour"), tmp_path, "percentiles").collect()
    assert len(found) == 5
    for r in found:
        mine = [v for t, i, v in rows if i == r["intent_type"] and r["window_start"] <= t < r["window_end"] and v is not None]
        assert r["timed"] == len(mine)
        if not mine:
            assert r["p50"] is None
            continue
        for name, level in levels.items():
            assert sum(v < r[name] for v in mine) / len(mine) <= level + rollup.RANK_ERROR
            assert sum(v <= r[name] for v in mine) / len(mine) >= level - rollup.RANK_ERROR


LOGS = "log_id long, timestamp timestamp, session_id string, query string"


def test_a_stream_that_breaks_off_writes_each_log_once(spark, tmp_path, monkeypatch):
    source, path, state = (str(tmp_path / n) for n in ("source", "logs", "state"))
    rows = [(i, DAY + dt.timedelta(hours=i), f"s{i % 5}", "q") for i in range(100)]

    def bring(part):
        spark.createDataFrame(part, LOGS).coalesce(1).write.mode("append").parquet(source)

    bring(rows[:60] + rows[:10])
    schema = spark.read.parquet(source).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        S.append_logs_once(stream, path, state, watermark="30 days").awaitTermination()

    run()
    # The next batch is written but breaks off before it counts as done.
    bring(rows[50:90] + rows[:5])
    whole = S._write_batch

    def broken(batch, path, number):
        whole(batch, path, number)
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "_write_batch", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(S, "_write_batch", whole)
    run()
    bring(rows[85:])
    run()
    found = spark.read.parquet(path)
    assert sorted(r["log_id"] for r in found.collect()) == list(range(100))
    assert found.select("day").distinct().count() == 5


def stored_files(path):
    return {
        os.path.basename(folder): sorted(n for n in names if n.endswith(".parquet"))
        for folder, _, names in os.walk(path)
        if "day=" in folder
    }


def test_feedback_is_merged_into_its_days_only(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(i, DAY + dt.timedelta(hours=6 * i), f"s{i % 3}", "q") for i in range(40)]
    S.append_logs(spark.createDataFrame(rows, LOGS), path)

    def feedback(*items):
        ratings = [(rows[i][1], rows[i][2], DAY + dt.timedelta(days=30, hours=h), r, p) for i, h, r, p in items]
        return spark.createDataFrame(ratings, S.FEEDBACK_SCHEMA)

    def state():
        found = S.read_logs(spark, path).collect()
        assert len(found) == 40
        return {r["log_id"]: (r["user_feedback"], r["user_clicked_product"]) for r in found if r["rated_at"]}

    before = stored_files(path)
    first = feedback((0, 1, 5, 11), (1, 1, 2, None), (1, 2, 3, 12), (9, 1, 9, 13))
    assert [d.day for d in S.merge_feedback(spark, path, first)] == [1]
    assert state() == {0: (5, 11), 1: (3, 12)}
    after = stored_files(path)
    assert after["day=2024-01-01"] != before["day=2024-01-01"]
    assert {d: f for d, f in after.items() if not d.endswith("01-01")} == {
        d: f for d, f in before.items() if not d.endswith("01-01")
    }
    # The same again, and an older rating, change nothing.
    assert S.merge_feedback(spark, path, first) == [] and S.merge_feedback(spark, path, feedback((1, 1, 1, 1))) == []
    assert stored_files(path) == after
    later = feedback((1, 5, 1, None), (20, 1, 4, 14), (2, 1, None, 15))
    assert [d.day for d in S.merge_feedback(spark, path, later)] == [1, 6]
    assert state() == {0: (5, 11), 1: (1, None), 2: (None, 15), 20: (4, 14)}
    unknown = spark.createDataFrame([(DAY + dt.timedelta(days=99), "s", DAY, 3, 1)], S.FEEDBACK_SCHEMA)
    assert S.merge_feedback(spark, path, unknown) == []
    assert S.read_logs(spark, path).where(F.col("rated_at").isNotNull()).count() == 4
