"""Views, maintenance, quality metrics, ranking and sinks on hand-made data."""

import json

import pytest
from helpers import HOUR, START, make_log, random_rows, row
from pyspark.sql import functions as F

from tidemark.functions import measures as M
from tidemark.operators import maintain, policies as P, quality as Q, reports, views
from tidemark.operators.replay import Replay, Run
from tidemark.session import scratch_path
from tidemark.sources import sinks
from tidemark.sources.changelog import LOG_SCHEMA, check_log, read_log


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_tombstones_ties_and_late_inserts(spark):
    log = make_log(
        spark,
        [
            row(1, 1, 0), row(2, 1, 1, deleted=True), row(3, 1, 2),  # deleted, then revived
            row(4, 2, 1), row(5, 2, 1),  # tie: the higher id wins
            row(7, 3, 1), row(6, 3, 4),  # the update arrives before its insert
            row(8, 4, 2, deleted=True),
            row(9, 5, None),  # never arrived
        ],
    )
    assert ids(views.snapshot_as_of(log)) == [3, 5, 6]
    assert ids(views.snapshot_as_of(log, START + HOUR)) == [5, 7]
    assert ids(views.latest_rows(log)) == [3, 5, 6, 8]
    assert ids(views.observed_log(log)) == [1, 2, 3, 5, 6, 7, 8, 9]
    assert views.truth_total(make_log(spark, [])).first()[0] == 0.0
    assert views.truth_total(make_log(spark, [row(1, 1, 0, deleted=True)])).first()[0] == 0.0


def test_period_is_cut_after_the_latest_row(spark):
    # The newest change lies outside the period, so the older one inside it must not count.
    log = make_log(spark, [row(1, 1, 0, event=1, amount=5), row(2, 1, 2, event=9, amount=7)])
    assert views.truth_period(log, START, START + 5 * HOUR).first()["total_sales"] == 0.0
    start, end = views.closed_window(START + 48 * HOUR, 24, 8)
    assert (start, end) == (START + 16 * HOUR, START + 40 * HOUR)


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_the_snapshot(spark, seed):
    log = make_log(spark, random_rows(seed))
    state = make_log(spark, [])
    cuts = [None, *(START + h * HOUR for h in (7, 8, 21.5, 40))]
    for last, cut in zip(cuts, cuts[1:]):
        state = maintain.incremental_merge(state, log, last, cut)
        assert ids(state) == ids(views.snapshot_as_of(log, cut))
    again = maintain.backfill_partition(state, log, START, START + 40 * HOUR)
    assert ids(again) == ids(state)
    marked = maintain.mark_final(
        P.window_finality(log, size=6, lateness=-1), START + 12 * HOUR
    ).select("is_final", (F.col("window_end") <= F.lit(str(START + 12 * HOUR)).cast("timestamp_ntz")).alias("due"))
    assert marked.filter("is_final != due").count() == 0


def test_committed_snapshot_without_commits_is_empty(spark):
    log = make_log(spark, random_rows(3, n=10))
    assert views.committed_snapshot(log, spark.createDataFrame([], "commit_cutoff timestamp_ntz")).count() == 0


def test_restatement_by_hand(spark):
    values = [(1, 10.0, "a"), (2, 12.0, "a"), (3, 12.0, "a"), (4, 15.0, "b"), (5, 15.0000001, "b"), (6, 20.0, None), (7, 21.0, None)]
    horizon = {"a": START, "b": START + HOUR, None: None}
    rows = [("p", START + t * HOUR, v, horizon[h]) for t, v, h in values]
    line = spark.createDataFrame(
        rows, "policy string, arrival_time timestamp_ntz, value double, max_visible_arrival_time timestamp_ntz"
    )
    got = Q.restatement(line).first()
    assert got["stability_same_horizon_transitions"] == 3 and got["stability_revision_count"] == 1
    assert got["stability_revision_ratio"] == pytest.approx(1 / 3)
    assert got["stability_total_abs_change"] == got["stability_max_abs_change"] == 2.0
    single = Q.restatement(line.filter("value = 10")).first()
    assert single["stability_revision_ratio"] == 0.0 and single["stability_same_horizon_transitions"] == 0


def test_unserved_points_and_percentile(spark):
    grid = spark.createDataFrame([(START + h * HOUR,) for h in (1, 2, 3, 4)], "arrival_time timestamp_ntz")
    line = spark.createDataFrame(
        [("p", START + 3 * HOUR, START + 2.5 * HOUR)],
        "policy string, arrival_time timestamp_ntz, max_visible_arrival_time timestamp_ntz",
    )
    got = Q.freshness(line, grid).first()
    lags = [0.0, 60.0, 30.0, 90.0]
    import numpy as np

    assert got["freshness_unserved_points"] == 2 and got["freshness_max_minutes"] == 90.0
    assert got["freshness_p95_minutes"] == pytest.approx(np.quantile(lags, 0.95))


@pytest.mark.parametrize("n", [1, 2, 20, 101])
def test_percentile_matches_linear_interpolation(spark, n):
    import numpy as np

    lags = [(i * 7919) % 1000 * 10**6 for i in range(n)]
    df = spark.createDataFrame([("p", x, False) for x in lags], "policy string, lag_us bigint, unserved boolean")
    got = Q.freshness_of(Q.lag_counts(df)).first()["freshness_p95_minutes"]
    assert got == pytest.approx(np.quantile(lags, 0.95) / 6e7)


def test_accuracy_ratio(spark):
    cases = [(0.0, 0.0, 1.0), (0.0, 5.0, 0.0), (100.0, 250.0, 0.0), (100.0, 90.0, 0.9), (-10.0, -5.0, 0.5)]
    df = spark.createDataFrame([c[:2] for c in cases], "t double, s double")
    got = [r[0] for r in df.select(Q.accuracy_ratio(F.col("t"), F.col("s"))).collect()]
    assert got == pytest.approx([c[2] for c in cases])


def test_normalize_coerces_and_keeps_the_last(spark):
    rows = [
        ("p", "2024-01-01 00:00:00", 1, "5", "x"), ("p", "2024-01-01 00:00:00", 3, "bad", "2024-01-01 00:00:00"),
        ("p", "2024-01-01 00:00:00", 2, "7", None), ("p", "nonsense", 9, "1", None),
    ]
    line = spark.createDataFrame(
        rows, "policy string, arrival_time string, event_count int, value string, max_visible_arrival_time string"
    )
    (got,) = Q.normalize_timeline(line).collect()
    assert got["event_count"] == 3 and got["value"] is None and got["max_visible_arrival_time"] == START


def test_evaluate_flags(spark):
    log = make_log(spark, random_rows(6, n=40))
    chosen = [P.Immediate(), P.FullRefresh(20), P.LaggedReconcile(15, 4)]
    runs = [Run(p, t.scenario) for t in Q.TARGETS for p in chosen]
    outcomes = Q.derived_metrics(Q.evaluate(Replay(log, runs)), 40)
    rows = {(r["scenario"], r["policy"]): r for r in outcomes.collect()}
    assert len(rows) == 18
    base = rows["B0", "immediate"]
    assert base["freshness_pass"] is None and base["live_accuracy_ratio"] is None and base["stability_pass"] is None
    best = rows["S5", "immediate"]
    assert best["freshness_max_minutes"] == 0.0 and best["live_accuracy_ratio"] == 1.0 and best["stability_pass"]
    assert best["write_amplification"] == 1.0 and best["freshness_headroom_minutes"] == 10.0
    slow = rows["S1", "full_refresh"]
    assert slow["freshness_pass"] is False and slow["freshness_max_minutes"] > 10
    assert json.loads(rows["S1", "lagged_reconcile"]["policy_params"]) == {"every": 15.0, "lag": 4.0}
    matrix = {r["scenario"]: r for r in reports.pass_matrix(outcomes, [p.name for p in chosen]).collect()}
    assert matrix["B0"]["full_refresh"] == "PASS" and matrix["S1"]["full_refresh"] == "FAIL"


def _candidate(scenario, phase, cadence, position, fresh, target=10.0, stability=None):
    return (
        scenario, "full_refresh", {"every": cadence}, cadence, phase, position, target, fresh,
        None if target is None else fresh is not None and fresh <= target, stability,
    )


def test_candidate_pick(spark):
    schema = (
        "scenario string, policy string, params map<string,double>, cadence_hours double, phase int, position int, "
        "freshness_target_minutes double, freshness_max_minutes double, freshness_pass boolean, "
        "stability_revision_ratio double"
    )
    rows = [
        # slowest passing base candidate
        _candidate("a", 0, 1.0, 0, 5.0), _candidate("a", 0, 2.0, 1, 9.0), _candidate("a", 0, 4.0, 2, 12.0),
        # only the fallback passes
        _candidate("b", 0, 9.0, 0, 50.0), _candidate("b", 1, 1.0, 1, 8.0), _candidate("b", 1, 0.5, 2, 7.0),
        # none passes: least gap, then stability, then order; a missing value is the worst
        _candidate("c", 0, 9.0, 0, None), _candidate("c", 0, 3.0, 1, 30.0, stability=0.5),
        _candidate("c", 0, 2.0, 2, 30.0, stability=0.1), _candidate("c", 1, 1.0, 3, 40.0),
        # no targets: everything passes
        _candidate("d", 0, 1.0, 0, 5.0, target=None), _candidate("d", 0, 6.0, 1, None, target=None),
    ]
    df = spark.createDataFrame(rows, schema)
    for c in ("live_accuracy", "daily_window_accuracy", "weekly_window_accuracy"):
        df = df.withColumns(
            {f"{c}_target_ratio": F.lit(None).cast("double"), f"{c}_ratio": F.lit(None).cast("double"),
             f"{c}_pass": F.lit(None).cast("boolean")}
        )
    df = df.withColumns(
        {"stability_target_revision_ratio": F.lit(None).cast("double"), "stability_pass": F.lit(None).cast("boolean")}
    )
    got = {r["scenario"]: (r["cadence_hours"], r["met_target"]) for r in reports.candidate_pick(df).collect()}
    assert got == {"a": (2.0, True), "b": (1.0, True), "c": (2.0, False), "d": (6.0, True)}
    twice = df.unionByName(df.withColumn("position", F.col("position") + 10))
    assert reports.distinct_candidates(twice).count() == len(rows)
    cadence = df.select(reports.cadence_hours().alias("c"), "cadence_hours").filter("c != cadence_hours")
    assert cadence.count() == 0


def test_row_load_report(spark):
    log = make_log(spark, random_rows(2, n=15))
    loads = Replay(log, [P.FullRefresh(10)]).row_loads()
    from tidemark.operators.sequence import source_row_number

    report = reports.row_load_report(loads, source_row_number(log, 15)).collect()
    assert all(r["source_row_number"] is not None and r["load_count"] > 0 for r in report)


def test_measures(spark):
    served = make_log(spark, [row(1, 1, 0, amount=2.5, quantity=2), row(2, 2, 0, amount=1, deleted=True)])
    (got,) = M.capture(served).collect()
    assert got["value"] == 5.0 and got["value_label"] == "Total Sales"
    frame = spark.createDataFrame([("a", 1, 2, 3.0), ("b", 2, 4, 5.0)], "n string, sale_id int, event_count int, x double")
    summary = M.summarize_measure("m", frame).first()
    assert (summary["value"], summary["value_label"]) == (4.0, "x")
    assert M.summarize_measure("m", frame.select("n", "sale_id")).first()["value"] is None
    direct = frame.select(F.col("x").alias("value"), F.lit("2024").alias("period_start"))
    assert M.summarize_measure("m", direct.limit(1)).first()["period_start"] == "2024"
    assert M.capture(served, {"none": lambda s: s.select("country")}).count() == 0
    with pytest.raises(Exception):
        M.capture(served, {"broken": lambda s: s.select("no_such_column")})


def test_sinks_round_trip(spark):
    rows = random_rows(4, n=30)
    log = make_log(spark, rows)
    path = scratch_path(spark, "log")
    sinks.save_log(log, path)
    sinks.save_log(make_log(spark, [row(100, 1, 1)]), path, mode="append")
    back = read_log(spark, path)
    assert back.count() == 31
    part = read_log(spark, path, after=START + 2 * HOUR, until=START + 26 * HOUR)
    assert ids(part) == ids(views.increment(back, START + 2 * HOUR, START + 26 * HOUR))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "arrival_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThan(arrival_time" in pushed and "LessThanOrEqual(arrival_tim" in pushed
    csv = scratch_path(spark, "csv")
    sinks.save_csv(log, csv, order=["arrival_time", "event_id"])
    assert sorted(sinks.read_csv(spark, csv, LOG_SCHEMA).collect()) == sorted(log.collect())
    with pytest.raises(ValueError):
        check_log(log.drop("amount"))
    params = spark.createDataFrame([({"b": 2.0, "a": 1.5},)], "p map<string,double>")
    text = params.select(sinks.params_to_json("p").alias("t"))
    assert text.first()[0] == '{"a":1.5,"b":2.0}'
    assert text.select(sinks.params_from_json("t")).first()[0] == {"a": 1.5, "b": 2.0}


def test_targets_as_a_table(spark):
    assert Q.targets_of(Q.targets_table(spark)) == list(Q.TARGETS)
    named = spark.createDataFrame([("x", 5.0)], "scenario string, freshness_target_minutes double")
    assert Q.targets_of(named) == [Q.Target("x", freshness_target_minutes=5.0)]


def test_loads_are_numbered_before_they_are_given_to_runs(spark):
    rows = random_rows(3, n=40, hot=True)
    log = make_log(spark, rows)
    runs = [Run(p, s) for s in ("S1", "S2", "S3") for p in (P.Immediate(), P.FullRefresh(10), P.LaggedReconcile(12, 5))]
    replay, numbers = Replay(log, runs), views.as_of(log, START + 1000 * HOUR).selectExpr("event_id", "event_id * 2 AS source_row_number")
    report = reports.replay_load_report(replay, numbers)
    plain = reports.row_load_report(replay.row_loads(), numbers)
    assert report.columns == plain.columns and sorted(map(str, report.collect())) == sorted(map(str, plain.collect()))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_result_tables_are_packed(spark):
    """A study repeats its labels on every row: plain text took some 50 times the log."""
    from pathlib import Path

    replay = Replay(make_log(spark, random_rows(4, n=60)), [Run(P.Immediate(), "S1"), Run(P.FullRefresh(6), "S1")])
    loads = reports.replay_load_report(replay, replay.log.selectExpr("event_id", "event_id AS source_row_number"))
    root = scratch_path(spark, "packed")
    sinks.save_results(root, replay.timeline(), Q.evaluate(replay), loads)
    files = [f.name for name in ("snapshots", "outcomes", "row_loads") for f in Path(root, name).glob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = sinks.read_csv(spark, f"{root}/row_loads", loads.withColumn("run_type", F.lit("scenarios")).schema)
    assert sorted(map(str, back.drop("run_type").collect())) == sorted(map(str, loads.collect()))


def test_percentile_across_minutes_and_groups_from_single_lags(spark):
    import numpy as np

    lags = {"a": [0] * 30, "b": [*range(19), 90 * 10**6, 10**12], "c": [5 * 10**9 + i for i in range(40)], "d": [7]}
    df = spark.createDataFrame([(k, x, x == 7) for k, xs in lags.items() for x in xs], "policy string, lag_us bigint, unserved boolean")
    for rows in (df, Q.lag_counts(df)):
        got = {r["policy"]: r for r in Q.freshness_of(rows).collect()}
        for k, xs in lags.items():
            assert got[k]["freshness_p95_minutes"] == pytest.approx(np.quantile(xs, 0.95) / 6e7)
            assert got[k]["freshness_max_minutes"] == pytest.approx(max(xs) / 6e7)
            assert got[k]["freshness_unserved_points"] == xs.count(7)


def test_restatement_across_slots_of_time(spark):
    # The row before is hours or days back, with a null value and a null horizon among them.
    values = [(0, 1.0, 0), (30, 2.0, 0), (31, None, 0), (500, 4.0, 0), (501, 4.5, None), (502, 5.0, 0), (502.5, 6.0, 0)]
    rows = [("p", START + t * HOUR, v, None if h is None else START) for t, v, h in values]
    line = spark.createDataFrame(rows, "policy string, arrival_time timestamp_ntz, value double, max_visible_arrival_time timestamp_ntz")
    for bound in (None, 10):
        got = Q.restatement(line, rows=bound).first()
        assert got["stability_same_horizon_transitions"] == 4 and got["stability_revision_count"] == 2
        assert got["stability_total_abs_change"] == 2.0


def test_large_logs_spread_over_time_get_hour_slots(spark):
    from dataclasses import replace

    from tidemark.functions.ladder import TASK_ROWS, TIME_WIDTHS
    from tidemark.sources.changelog import profile

    found = profile(make_log(spark, [row(1, 1, 0), row(2, 1, 0.5), row(3, 2, 1.5), row(4, 2, None)]))
    assert (found.rows, found.densest_hour) == (4, 2)
    log = make_log(spark, [row(1, 1, 0)])
    many = replace(found, rows=100 * TASK_ROWS)
    assert Replay(log, [P.FullRefresh(6), P.Immediate()], profile=many)._widths != TIME_WIDTHS
    crowded = replace(many, densest_hour=2 * TASK_ROWS)
    assert Replay(log, [P.Immediate()], profile=crowded)._widths == TIME_WIDTHS


def test_served_totals_do_not_repeat_the_log_for_each_policy(spark):
    log = make_log(spark, random_rows(4, n=30))
    replay = Replay(log, [P.Immediate(), P.FullRefresh(6), P.WindowGate(6, 12)])
    plan = Q._served_and_true(replay, replay._at(None), [None], loads=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # above the sums, not below them
    empty = Replay(make_log(spark, []), [P.Immediate(), P.FullRefresh(6)])
    assert Q.accuracy(empty).count() == 0
