"""Stored states, bucketed tables and calendars, against the plain operators and brute force."""

import random
from datetime import datetime

import pytest
from helpers import HOUR, START, make_log, random_rows, row
from pyspark.sql import functions as F

from tidemark.operators import calendar, maintain, views
from tidemark.operators.keyed_table import KeyedTable
from tidemark.session import scratch_path
from tidemark.sources import sinks, snapshots
from tidemark.sources.changelog import LOG_SCHEMA

DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields)


def rows_of(df):
    return sorted(map(str, df.select(*LOG_SCHEMA.fieldNames()).collect()))


# -- stored states -------------------------------------------------------------------------------------------


def test_state_from_the_newest_stored_one(spark):
    log = make_log(spark, random_rows(61, n=120, span=100, null_key=True, hot=True))
    root = scratch_path(spark, "states")
    sinks.save_log(log, f"{root}/log")
    assert rows_of(snapshots.state_as_of(spark, f"{root}/log", f"{root}/states", START + 30 * HOUR)) == rows_of(
        views.snapshot_as_of(log, START + 30 * HOUR)
    )
    for hour in (20, 50, 50, 35):  # a repeat, and one between the others
        snapshots.store_state(spark, f"{root}/log", f"{root}/states", START + hour * HOUR)
    spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/states/as_of=1704300000000000")
    )  # a state that was never finished
    assert snapshots.snapshot_times(spark, f"{root}/states") == [START + h * HOUR for h in (20, 35, 50)]
    for hour in (10, 20, 21, 49.5, 50, 80, 200):
        at = START + hour * HOUR
        found = snapshots.state_as_of(spark, f"{root}/log", f"{root}/states", at)
        assert rows_of(found) == rows_of(views.snapshot_as_of(log, at)), hour


def test_only_the_tail_is_read(spark):
    log = make_log(spark, [row(i, i, i) for i in range(200)])
    root = scratch_path(spark, "tail")
    sinks.save_log(log, f"{root}/log")
    snapshots.store_state(spark, f"{root}/log", f"{root}/states", START + 100 * HOUR)
    found = snapshots.state_as_of(spark, f"{root}/log", f"{root}/states", START + 130 * HOUR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(arrival_date" in plan and "2024-01-05" in plan and "2024-01-06" in plan
    scans = [m for m in found._jdf.queryExecution().executedPlan().collectLeaves().mkString("\n").split("\n") if "arrival_date" in m]
    assert len(scans) == 1
    assert found.count() == 131


# -- bucketed tables -----------------------------------------------------------------------------------------


def opened(spark, path, buckets=8, name=None):
    return KeyedTable(spark, name or f"t_{path.rpartition('-')[2]}", path, DDL, buckets=buckets)


def files_of(spark, path):
    paths = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    return {r.p for r in paths}


@pytest.mark.parametrize("null_key", [False, True])
def test_merges_equal_the_plain_ones(spark, null_key):
    log = make_log(spark, random_rows(63, n=150, keys=40, null_key=null_key, hot=null_key))
    table = opened(spark, scratch_path(spark, "merge"))
    state = views.snapshot_as_of(log, START + 10 * HOUR)
    table.fill(state)
    assert rows_of(table.read()) == rows_of(state)
    for last, cutoff in ((10, 20), (20, 21), (21, 60)):
        table.merge(log, START + last * HOUR, START + cutoff * HOUR)
        assert rows_of(table.read()) == rows_of(views.snapshot_as_of(log, START + cutoff * HOUR))
    expected = rows_of(maintain.backfill_partition(views.snapshot_as_of(log), log, START + 5 * HOUR, START + 15 * HOUR)) if not null_key else None
    table.backfill(log, START + 5 * HOUR, START + 15 * HOUR)
    assert expected is None or rows_of(table.read()) == expected
    again = opened(spark, table.path, name=f"{table.name}_again")  # as another session would
    assert rows_of(again.read()) == rows_of(table.read())
    table.fill(state)
    assert rows_of(table.read()) == rows_of(state)
    assert table.merge(log.limit(0), None, START) == []


def test_other_buckets_stay_as_they_are(spark):
    table = opened(spark, scratch_path(spark, "buckets"))
    table.fill(make_log(spark, [row(i, i, 1) for i in range(400)]))
    before = files_of(spark, table.path)
    assert len(before) == 8
    changes = make_log(spark, [row(1000, 7, 2), row(1001, 5000, 2, deleted=True)])
    touched = table.upsert(changes)
    after = files_of(spark, table.path)
    assert 1 <= len(touched) <= 2 and len(before & after) == 8 - len(touched) and len(after) == 8
    assert table.read().filter("sale_id = 7").first().event_id == 1000


def test_a_merge_shuffles_the_changes_only(spark):
    table = opened(spark, scratch_path(spark, "plan"))
    table.fill(make_log(spark, [row(i, i, 1) for i in range(400)]))
    changes = make_log(spark, [row(1000, 7, 2)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.merged(changes, [0, 1]).filter("sale_id IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("SortMergeJoin") :]
    left, right = joined.split("Scan parquet", 1)[0], joined.split("Scan parquet", 1)[1]
    assert "Exchange" not in left and "Bucketed: true" in joined
    assert "PartitionFilters" in right and "Exchange" in right


def test_an_emptied_bucket_goes(spark):
    table = opened(spark, scratch_path(spark, "empty"), buckets=64)
    table.fill(make_log(spark, [row(1, 1, 1), row(2, 2, 1)]))
    table.upsert(make_log(spark, [row(3, 1, 2, deleted=True)]))
    assert [r.sale_id for r in table.read().collect()] == [2]
    assert [r.sale_id for r in opened(spark, table.path, 64, f"{table.name}_again").read().collect()] == [2]


# -- calendars -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,hot_rows", [(65, 1_000_000), (66, 2)])
def test_calendar(spark, seed, hot_rows):
    rows = random_rows(seed, n=90, hot=True, null_key=True)
    rng = random.Random(seed)
    times = [(START + rng.choice([rng.random() * 50, rng.randrange(50)]) * HOUR, rng.random() < 0.3) for _ in range(15)]
    times += [times[0], (None, True), (START - HOUR, True), (datetime(2030, 1, 1), False)]
    table = spark.createDataFrame(times, calendar.CALENDAR_DDL)
    loads = calendar.calendar_loads(make_log(spark, rows), table, 6, len(rows), hot_rows=hot_rows)
    whole = {}
    for at, full in times:
        if at is not None:
            whole[at] = whole.get(at, False) or full
    expected = []
    for at, full in whole.items():
        newest = {}
        for r in sorted((r for r in rows if r[3] is not None and r[3] <= at), key=lambda r: (r[3], r[0])):
            newest[r[1]] = r
        expected += [(r[0], at) for r in newest.values() if not r[11] and (full or r[3] >= at - 6 * HOUR)]
    assert sorted((r.event_id, r.at) for r in loads.collect()) == sorted(expected)
    counts = {r.event_id: (r.load_count, r.first_loaded) for r in calendar.load_counts(loads).collect()}
    assert counts == {e: (sum(x == e for x, _ in expected), min(t for x, t in expected if x == e)) for e, _ in expected}
    totals = {r.at: r.loaded_rows for r in calendar.refresh_totals(loads, table).collect()}
    assert totals == {at: sum(t == at for _, t in expected) for at in whole}


@pytest.mark.parametrize("seed,hot_rows", [(67, 1_000_000), (68, 2)])
def test_calendar_without_its_loads(spark, seed, hot_rows, monkeypatch):
    """Counts and totals as from the single loads, without a row for each of them."""
    rows = random_rows(seed, n=90, hot=True, null_key=True)
    rng = random.Random(seed)
    times = [(START + rng.choice([rng.random() * 50, rng.randrange(50)]) * HOUR, rng.random() < 0.3) for _ in range(15)]
    times += [times[0], (None, True), (START - HOUR, True), (datetime(2030, 1, 1), False)]
    table, log = spark.createDataFrame(times, calendar.CALENDAR_DDL), make_log(spark, rows)
    loads = calendar.calendar_loads(log, table, 6, len(rows), hot_rows=hot_rows)
    expected = sorted(calendar.load_counts(loads).collect()), sorted(calendar.refresh_totals(loads, table).collect())
    monkeypatch.setattr(calendar, "points_within", None)
    counts = calendar.calendar_load_counts(log, table, 6, len(rows), hot_rows=hot_rows)
    totals = calendar.calendar_refresh_totals(log, table, 6, len(rows), hot_rows=hot_rows)
    assert (sorted(counts.collect()), sorted(totals.collect())) == expected


def test_calendar_queries_make_no_row_for_a_load(spark, monkeypatch):
    from tidemark.plans import queries

    for name in ("points_within", "load_counts", "refresh_totals"):
        monkeypatch.setattr(calendar, name, None)
    for name in ("calendar_loads", "calendar_loads_hot_keys", "calendar_refreshes"):
        assert queries.REGISTRY[name](spark, "/root/testdata/sf0.001").count() > 0
