"""Streams with keyed state and the exact gate, against the batch operators; ties across cuts, restarts, repeats."""

import random

import pytest
from helpers import HOUR, START, make_log, random_rows, row

from tidemark.operators import policies as P, views
from tidemark.operators.replay import Replay
from tidemark.session import scratch_path
from tidemark.streaming import gate, jobs, keyed, landing


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def torn_parts(spark, seed, parts=3, **options):
    """(log, the log in parts by arrival, each arrival at a border torn apart at random)."""
    rows = random_rows(seed, n=90, span=12, **options)
    rng = random.Random(seed)
    ordered = sorted(rows, key=lambda r: (r[3], rng.random()))
    cuts = sorted(rng.sample(range(len(rows)), parts - 1))
    pieces = [ordered[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    return make_log(spark, rows), [make_log(spark, piece) for piece in pieces]


@pytest.mark.parametrize("seed", [51, 52])
def test_keyed_state(spark, seed):
    log, parts = torn_parts(spark, seed, null_key=True)
    root = scratch_path(spark, "keyed")
    seen = None
    for part in parts:
        landing.land(part, f"{root}/in", lambda: keyed.start_keyed_state(jobs.read_stream(spark, f"{root}/in"), f"{root}/checkpoint"))
        seen = part if seen is None else seen.unionByName(part)
        assert ids(keyed.read_keyed_state(spark, f"{root}/checkpoint")) == ids(views.snapshot_as_of(seen))
    assert ids(views.snapshot_as_of(log)) == ids(keyed.read_keyed_state(spark, f"{root}/checkpoint"))


@pytest.mark.parametrize("seed", [53, 54])
def test_dedup_across_batches(spark, seed):
    log, parts = torn_parts(spark, seed, null_key=True)
    root = scratch_path(spark, "dedup")
    for part in parts:
        landing.land(part, f"{root}/in", lambda: keyed.start_dedup(jobs.read_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint"))
    found = keyed.read_dedup(spark, f"{root}/table", f"{root}/checkpoint")
    assert sorted(map(str, found.collect())) == sorted(map(str, views.observed_log(log).collect()))


def test_dedup_state_is_bounded(spark):
    """Once later rows have come, older keys leave the state."""
    root = scratch_path(spark, "bounded")
    for hour in (0, 10, 20):
        rows = [row(hour * 100 + i, i, hour + i / 100) for i in range(20)]
        landing.land(make_log(spark, rows), f"{root}/in", lambda: keyed.start_dedup(jobs.read_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint"))
    assert spark.read.format("statestore").load(f"{root}/checkpoint").count() == 1  # the last arrival
    assert jobs.read_batches(spark, f"{root}/table", jobs.LOG_DDL).count() == 59


@pytest.mark.parametrize("size,lateness", [(6, 3), (5, 0), (6, -1)])
@pytest.mark.parametrize("seed", [55, 56])
def test_gate(spark, size, lateness, seed):
    log, parts = torn_parts(spark, seed, parts=4, free=True)
    root = scratch_path(spark, "gate")
    for part in parts:
        landing.land(part, f"{root}/in", lambda: gate.start_gate(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint", size, lateness))
    accepted = Replay(log, [P.WindowGate(size, lateness)]).row_loads()
    assert ids(gate.read_gate(spark, root, size, lateness)) == ids(accepted)


def test_gate_without_event_times_and_repeated(spark):
    rows = [row(0, 1, 1), row(1, 2, 5, 4, amount=5), row(2, 3, 6, amount=7), (9, 4, None, START + 9 * HOUR, *row(0, 0, 0)[4:])]
    rows[0] = (0, 1, None, *rows[0][3:])
    root = scratch_path(spark, "repeat")
    make_log(spark, rows).coalesce(1).write.parquet(f"{root}/in")
    for checkpoint in ("first", "second"):  # the second query starts over with batch 0
        gate.start_gate(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/{checkpoint}", 3, 1).awaitTermination()
    assert ids(gate.read_gate(spark, root, 3, 1)) == [0, 1, 2]
    assert gate.read_gate(spark, f"{root}/nothing", 3, 1).count() == 0
