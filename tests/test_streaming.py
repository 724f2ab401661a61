"""The streaming jobs against the batch operators, with repeated batches."""

import pytest
from helpers import HOUR, START, make_log, random_rows

from tidemark.operators import policies as P, views
from tidemark.operators.replay import Replay
from tidemark.session import scratch_path
from tidemark.sources.changelog import profile
from tidemark.streaming import jobs, landing

CUTS = [START + 9.3 * HOUR, START + 22 * HOUR]


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, random_rows(21, n=80))


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def run(spark, log, start):
    root = scratch_path(spark, "test")
    landing.replay_in_steps(
        log, CUTS, f"{root}/in", lambda: start(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint")
    )
    return root


def test_latest_state(spark, log):
    root = run(spark, log, lambda s, r, c: jobs.start_latest_state(s, f"{r}/table", c))
    assert ids(jobs.read_latest_state(spark, f"{root}/table")) == ids(views.snapshot_as_of(log))


@pytest.mark.parametrize("every,lag", [(4, 1.5), (1, 0)])
def test_reconcile(spark, log, every, lag):
    root = run(spark, log, lambda s, r, c: jobs.start_reconcile(s, r, c, every, lag))
    policy = P.LaggedReconcile(every, lag)
    assert ids(jobs.read_reconciled(spark, root)) == ids(Replay(log, [policy]).served())
    marks = policy.prepare(log, profile(log)).marks
    fired = {(r["fired_us"], r["cutoff_us"]) for r in jobs.read_reconciles(spark, root).collect()}
    assert fired == {(r["at_us"], r["cutoff_us"]) for r in marks.collect()}


@pytest.mark.parametrize("every", [5, 0])
def test_commits(spark, log, every):
    root = run(spark, log, lambda s, r, c: jobs.start_commits(s, r, c, every))
    policy = P.CommitSnapshot(every)
    assert ids(jobs.read_committed(spark, root)) == ids(Replay(log, [policy]).served())
    commits = {r["commit_us"] for r in jobs.read_commits(spark, root).collect()}
    assert commits == {r["commit_us"] for r in policy.commits(log, profile(log)).collect()}


def test_repeated_batch_changes_nothing(spark, log):
    """A batch that is processed again, as after a failure, leaves the same tables."""
    root = scratch_path(spark, "again")
    source = f"{root}/in"
    log.coalesce(1).write.parquet(source)
    for checkpoint in ("first", "second"):  # the second query starts over with batch 0
        jobs.start_reconcile(jobs.read_stream(spark, source), root, f"{root}/{checkpoint}", 4, 1).awaitTermination()
    assert ids(jobs.read_reconciled(spark, root)) == ids(Replay(log, [P.LaggedReconcile(4, 1)]).served())
    assert jobs.read_reconciles(spark, root).count() == len(
        P.LaggedReconcile(4, 1).prepare(log, profile(log)).marks.collect()
    )


def test_windowed_sales_are_final(spark, log):
    root = run(spark, log, lambda s, r, c: jobs.start_windowed_sales(s, f"{r}/table", c, "6 hours", "3 hours"))
    windows = jobs.read_windowed_sales(spark, f"{root}/table").collect()
    starts = [w["window_start"] for w in windows]
    assert len(starts) == len(set(starts)) > 0
    newest = max(r["event_time"] for r in log.collect())
    assert all(w["window_end"] <= newest - 3 * HOUR for w in windows)
