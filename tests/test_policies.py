"""Every policy against the step-by-step replay, on random logs with ties, with and without hot-key handling."""

from datetime import datetime

import pytest
from helpers import START, HOUR, Naive, make_log, random_rows, row
from pyspark.sql import functions as F

from tidemark.operators import policies as P
from tidemark.operators.commits import commit_chain
from tidemark.operators.replay import Replay, Run
from tidemark.operators.views import snapshot_as_of
from tidemark.functions.clock import hours, micros_of

CASES = [
    P.Immediate(),
    P.FullRefresh(every=3),
    P.PeriodicSnapshot(every=2.5),
    P.HotWindow(hot=4, every=3, full_every=10),
    P.HotWindow(hot=2, every=5, full_every=12),
    P.HotWindow(hot=1, every=4, full_every=3),
    P.LaggedReconcile(every=4, lag=1.5),
    P.LaggedReconcile(every=1, lag=0),
    P.WindowGate(size=6, lateness=3),
    P.WindowGate(size=5, lateness=0),
    P.WindowGate(size=6, lateness=-1),
    P.CommitSnapshot(every=3),
    P.CommitSnapshot(every=0),
]


def compare(replay, rows):
    timeline = {}
    for r in replay.timeline().collect():
        timeline.setdefault(r["scenario"], {})[r["arrival_time"]] = (
            r["event_count"], r["value"], r["max_visible_arrival_time"],
        )
    loads = {}
    for r in replay.row_loads().collect():
        loads.setdefault(r["scenario"], {})[r["event_id"]] = r["load_count"]
    for i, policy in enumerate(CASES):
        naive = getattr(Naive(rows), policy.name)(**policy.params())
        got = timeline.get(str(i), {})
        assert got.keys() == naive.timeline.keys(), policy
        for at, expected in naive.timeline.items():
            assert got[at] == pytest.approx(expected) if expected[2] is None else got[at][2] == expected[2], policy
            assert got[at][:2] == pytest.approx(expected[:2]), (policy, at)
        assert loads.get(str(i), {}) == dict(naive.loads), policy


@pytest.mark.parametrize("seed,hot_rows,hot", [(1, 1_000_000, False), (2, 1_000_000, True), (3, 4, True), (4, 1, False)])
def test_replay_equals_steps(spark, seed, hot_rows, hot):
    rows = random_rows(seed, hot=hot)
    runs = [Run(p, str(i)) for i, p in enumerate(CASES)]
    replay = Replay(make_log(spark, rows), runs, hot_rows=hot_rows).materialized()
    compare(replay, rows)


@pytest.mark.parametrize("seed,hot_rows", [(31, 1_000_000), (31, 4), (32, 1), (33, 2)])
def test_free_event_times_and_null_keys(spark, seed, hot_rows):
    rows = random_rows(seed, hot=True, free=True, null_key=True)
    runs = [Run(p, str(i)) for i, p in enumerate(CASES)]
    compare(Replay(make_log(spark, rows), runs, hot_rows=hot_rows).materialized(), rows)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_gate_drops_rows_without_event_time(spark, hot_rows):
    """Accepted before the first watermark, dropped from then on."""
    rows = [row(0, 1, 1), row(1, 2, 5, 4, amount=5), row(2, 3, 6, amount=7), (9, 4, None, START + 9 * HOUR, *row(0, 0, 0)[4:])]
    rows[0] = (0, 1, None, *rows[0][3:])
    timeline = Replay(make_log(spark, rows), [P.WindowGate(3, 1)], hot_rows=hot_rows).timeline()
    assert [r.value for r in timeline.orderBy("arrival_time").collect()] == [1.0, 6.0, 13.0, 13.0]


def test_stray_event_time_makes_no_cells(spark):
    rows = [*random_rows(3), (999, 77, datetime(9998, 1, 1), START + 50 * HOUR, *row(0, 0, 0)[4:])]
    replay = Replay(make_log(spark, rows), [P.WindowGate(0.25, 1)])
    assert replay._prepared[0].cells.table.count() <= len(rows) + 2


def test_empty_and_single_row_logs(spark):
    chosen = [P.Immediate(), P.FullRefresh(3), P.LaggedReconcile(3, 1), P.CommitSnapshot(2), P.WindowGate(3, 1)]
    empty = Replay(make_log(spark, []), chosen)
    assert empty.timeline().count() == 0 and empty.row_loads().count() == 0
    one = Replay(make_log(spark, [row(1, 1, 0, amount=5)]), chosen)
    values = {r["policy"]: r["value"] for r in one.timeline().collect()}
    # The reconcile at the only arrival shows what came an hour before it: nothing.
    assert values == {
        "immediate": 5.0, "full_refresh": 5.0, "lagged_reconcile": 0.0, "commit_snapshot": 5.0, "window_gate": 5.0,
    }


def test_gate_rejects_a_row_of_the_batch_that_moves_the_watermark(spark):
    rows = [row(1, 1, 0, event=0), row(2, 2, 5, event=1), row(3, 3, 5, event=10)]
    replay = Replay(make_log(spark, rows), [P.WindowGate(size=2, lateness=0)])
    assert {r["event_id"] for r in replay.row_loads().collect()} == {1, 3}
    final = {r["event_id"]: r["is_final"] for r in replay.accepted_windows().collect()}
    assert final == {1: True, 3: False}


def test_hot_window_misses_rows_between_refreshes(spark):
    # Hot windows cover (2,4] and (6,8]; the row at 1 appears with the full refresh at 8, if nothing newer was seen.
    rows = [row(0, 0, 0), row(1, 1, 1, amount=10), row(2, 2, 1, amount=20), row(3, 2, 3.5, amount=5), row(4, 9, 9)]
    replay = Replay(make_log(spark, rows), [P.HotWindow(hot=2, every=4, full_every=8)])
    values = [r["value"] for r in replay.timeline().orderBy("arrival_time").collect()]
    assert values == [1.0, 6.0, 16.0]


def test_invariants(spark):
    rows = random_rows(11)
    log = make_log(spark, rows)
    chosen = [P.Immediate(), P.WindowGate(3, -1), P.CommitSnapshot(0), P.FullRefresh(4), P.PeriodicSnapshot(4)]
    replay = Replay(log, chosen).materialized()
    lines = {}
    for r in replay.timeline().collect():
        lines.setdefault(r["policy"], {})[r["arrival_time"]] = (r["value"], r["max_visible_arrival_time"])
    assert lines["immediate"] == lines["window_gate"] == lines["commit_snapshot"]
    assert lines["full_refresh"] == lines["periodic_snapshot"]
    truth = snapshot_as_of(log).agg(F.sum(F.col("amount") * F.col("quantity"))).first()[0]
    assert lines["immediate"][max(lines["immediate"])][0] == pytest.approx(truth)
    served = {r["event_id"] for r in replay.served(0).collect()}
    assert served == {r["event_id"] for r in snapshot_as_of(log).collect()}
    loads = replay.row_loads().groupBy("policy").agg(F.sum("load_count").alias("n"))
    totals = {r["policy"]: r["rows_loaded_count"] for r in replay.rows_loaded().collect()}
    assert {r["policy"]: r["n"] for r in loads.collect()} == totals


def test_several_additive_measures(spark):
    rows = random_rows(5, n=20)
    measures = {"total_sales": F.col("amount") * F.col("quantity"), "units": F.col("quantity").cast("bigint")}
    replay = Replay(make_log(spark, rows), [P.FullRefresh(100)], measures=measures)
    got = {r["metric"]: r for r in replay.timeline().collect()}
    assert got["units"]["value_label"] == "units" and set(got) == {"total_sales", "units"}


@pytest.mark.parametrize("gaps", ["regular", "random", "clumped"])
@pytest.mark.parametrize("every", [0.5, 3, 1000])
@pytest.mark.parametrize("options", [{}, {"block": 1}, {"block": 7}, {"block": 7, "walked": 0}])
def test_commit_chain(spark, gaps, every, options):
    import random

    rng = random.Random(7)
    points = {
        "regular": [i for i in range(50)],
        "random": sorted(rng.random() * 60 for _ in range(80)),
        "clumped": sorted([rng.random() for _ in range(30)] + [40 + rng.random() * 5 for _ in range(30)] + [90]),
    }[gaps]
    log = make_log(spark, [row(i, i, p) for i, p in enumerate(points)])
    times = sorted({r["arrival_time"] for r in log.collect()})
    expected, due = [], None
    for t in times:
        if due is None or t >= due:
            expected.append(t)
            due = t + every * HOUR
    got = commit_chain(log, hours(every), micros_of(times[0]), micros_of(times[-1]), **options)
    assert sorted(r[0] for r in got.collect()) == [micros_of(t) for t in expected]


def test_bad_parameters():
    for bad in (lambda: P.WindowGate(size=0), lambda: P.HotWindow(every=0), lambda: P.FullRefresh(0).step()):
        with pytest.raises(ValueError):
            bad()


def test_long_grid_uses_the_ladder(spark):
    rows = [row(0, 1, 0, amount=3), row(1, 1, 30, amount=4), row(2, 2, 150, amount=5)]
    replay = Replay(make_log(spark, rows), [P.PeriodicSnapshot(every=0.0)])  # raised to 0.001 hours
    timeline = replay.timeline()
    assert timeline.count() == 150_001
    at_30 = timeline.filter(F.col("arrival_time") == F.lit(str(START + 30 * HOUR)).cast("timestamp_ntz")).first()
    assert (at_30["value"], at_30["event_count"]) == (4.0, 2)
