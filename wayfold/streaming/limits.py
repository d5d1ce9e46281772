"""Sliding rate limits of a stream of calls, with bounded state per user."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The periods in which calls are limited, in microseconds.
PERIODS = {"minute": 60_000_000, "day": 86_400_000_000}
OUTPUT = "user string, period string, called timestamp, allowed int"
STATE = "waiting array<long>, recent array<long>"


def rate_breaches(
    calls: DataFrame,
    user: str,
    limits: dict[str, int],
    time: str = "timestamp",
    watermark: str = "10 minutes",
) -> DataFrame:
    """Every call that is one too many in the minute or day that ends with it: ``user, period, called, allowed``.

    A call breaks a limit of ``n`` when the ``n``-th call before it lies less than the period back; calls of one time
    count in any order, so a breach is a row for each of those that exceed. A user's state is the last calls, as many as
    the largest limit, and those the watermark has not passed yet, which wait so that calls out of order
    are counted in order. Recent calls go with the longest period. Calls later than the watermark are
    dropped, as are those without user or time. ``limits`` is by period, ``minute`` and ``day``.
    """
    unknown = set(limits) - set(PERIODS)
    if unknown or any(n < 1 for n in limits.values()):
        raise ValueError(f"limits are positive numbers by {sorted(PERIODS)}")
    timed = calls.select(F.col(user).cast("string").alias("user"), F.col(time).cast("timestamp").alias("at"))
    timed = timed.withColumn("micros", F.unix_micros("at")).withWatermark("at", watermark)
    # One condition on both columns, which cannot be moved before the watermark: time passes for rows without user, too.
    timed = timed.where(F.size(F.array_compact(F.array("user", F.col("at").cast("string")))) == 2)
    most, longest = max(limits.values()), max(PERIODS[p] for p in limits)

    def count(
        key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        waiting, recent = state.get if state.exists else ([], [])
        waiting = list(waiting)
        for frame in frames:
            waiting.extend(frame["micros"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        due = sorted(t for t in waiting if t <= passed)
        waiting = [t for t in waiting if t > passed]
        known = [*recent, *due]
        found = []
        for at in range(len(recent), len(known)):
            for period, allowed in limits.items():
                if at >= allowed and known[at] - known[at - allowed] < PERIODS[period]:
                    found.append((key[0], period, pd.Timestamp(known[at], unit="us"), allowed))
        recent = [t for t in known[-most:] if passed - t < longest]
        if waiting or recent:
            state.update((waiting, recent))
            # The next call that waits, or the end of the last recent one's period.
            until = min(waiting) if waiting else recent[-1] + longest
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(found, columns=["user", "period", "called", "allowed"])

    return timed.groupBy("user").applyInPandasWithState(
        count, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
