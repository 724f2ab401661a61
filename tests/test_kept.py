"""Timelines kept up to date against whole ones; bounds observed while a log is written."""

import random
from datetime import date, datetime

import pytest
from helpers import HOUR, START, make_log, random_rows, row

from tidemark.operators import policies as P
from tidemark.operators.kept import KeptTimeline
from tidemark.operators.replay import Replay
from tidemark.session import scratch_path
from tidemark.sources import sinks
from tidemark.sources.changelog import profile, read_log


def points(df):
    return sorted((r.arrival_time, r.event_count, r.value) for r in df.collect())


@pytest.mark.parametrize("seed,hot_rows", [(71, 1_000_000), (72, 3)])
def test_appends_in_any_order_equal_the_whole(spark, seed, hot_rows):
    rows = random_rows(seed, n=90, hot=True, null_key=True, span=90)
    random.Random(seed).shuffle(rows)  # batches overlap in time, and ties of a key lie in different ones
    kept = KeptTimeline(spark, scratch_path(spark, "kept"), buckets=4, hot_rows=hot_rows)
    for number, end in enumerate((30, 50, 90)):
        kept.append(make_log(spark, rows[[0, 30, 50][number] : end]), number)
        whole = Replay(make_log(spark, rows[:end]), [P.Immediate()]).timeline()
        assert points(kept.read()) == points(whole)
    kept.append(make_log(spark, rows[50:]), 2)  # the same batch again
    assert points(kept.read()) == points(whole)
    days = kept.read(date(2024, 1, 2), date(2024, 1, 3))
    assert points(days) == [p for p in points(whole) if datetime(2024, 1, 2) <= p[0] < datetime(2024, 1, 4)]


def test_only_touched_days_are_written(spark):
    kept = KeptTimeline(spark, scratch_path(spark, "touched"), buckets=4)
    assert points(kept.read()) == []
    kept.append(make_log(spark, [row(i, i % 20, i * 6) for i in range(40)]), 0)
    touched = kept.append(make_log(spark, [row(100, 3, 25, amount=5), row(101, 99, 26)]), 1)
    # Key 3 changes at hours 18 and 138: a change in between moves the value then, and what follows moves less.
    assert touched == [date(2024, 1, 2), date(2024, 1, 6)]
    assert kept.append(make_log(spark, []), 2) == []


def test_bounds_are_observed_while_writing(spark):
    log = make_log(spark, random_rows(73, null_key=True))
    path = scratch_path(spark, "log")
    bounds = sinks.save_log(log, path)
    assert bounds == profile(log, event_bounds=True)
    spark.sparkContext.setJobGroup("replay", "no profile")
    try:
        replay = Replay(read_log(spark, path), [P.WindowGate(6, 3)], profile=bounds)
        assert replay.timeline_bound == 60
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("replay") == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert points(replay.timeline()) == points(Replay(log, [P.WindowGate(6, 3)]).timeline())
    empty = sinks.save_log(log.limit(0), scratch_path(spark, "log"))
    assert empty.rows == 0 and empty.empty
    assert sinks.save_log(log.drop("event_time"), scratch_path(spark, "log")).first_event is None


def test_profile_of_nulls(spark):
    rows = [row(1, 1, None), row(2, 1, 5)]
    bounds = sinks.save_log(make_log(spark, rows), scratch_path(spark, "log"))
    assert bounds.rows == 2 and bounds == profile(make_log(spark, rows), event_bounds=True)
    assert START + 5 * HOUR == bounds.last_arrival_time
