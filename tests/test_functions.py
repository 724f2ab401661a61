"""Clock arithmetic, ladders, hot groups, as-of joins, row numbers."""

import random
from datetime import datetime

from decimal import Decimal

import pytest
from tidemark.functions.measures import sales_amount
from tidemark import session
from helpers import HOUR, START, make_log, random_rows, row
from pyspark.sql import functions as F

from tidemark.functions.clock import Grid, ceil_div, floor_div, micros_of, ntz, to_micros, to_timestamp
from tidemark.functions.ladder import running
from tidemark.functions.skew import MAX_HOT_GROUPS, hot_limit, split_hot, with_group_minimum
from tidemark.operators.asof import asof_join
from tidemark.operators.sequence import running_event_count, row_watermark, source_row_number
from tidemark.sources.changelog import profile, unique_arrivals


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    times = [
        datetime(2024, 3, 10, 2, 30, 0, 123456), datetime(2024, 11, 3, 1, 30), datetime(1969, 7, 20, 20, 17, 40, 1),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        got = df.select("t", to_micros("t").alias("us"), to_timestamp(to_micros("t")).alias("back")).collect()
        literal = df.filter(F.col("t") == ntz(times[0])).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r["us"], r["back"]) for r in got] == [(micros_of(t), t) for t in times]
    assert literal == 1


def test_divisions_and_grid(spark):
    df = spark.createDataFrame([(x,) for x in (-7, -6, -1, 0, 1, 6, 7, 12)], "x bigint")
    for r in df.select("x", floor_div(F.col("x"), 6).alias("f"), ceil_div(F.col("x"), 6).alias("c")).collect():
        assert (r["f"], r["c"]) == (r["x"] // 6, -(-r["x"] // 6))
    grid = Grid(0, 5, 12)
    got = df.select("x", grid.at_or_after(F.col("x")).alias("g")).collect()
    assert {r["x"]: r["g"] for r in got if r["x"] >= 0} == {0: 0, 1: 5, 6: 10, 7: 10, 12: None}
    assert Grid(0, 5, -1).size == 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("bound", [None, 1000])
def test_running(spark, strict, reverse, bound):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-300, 300), rng.randrange(-50, 50)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, p bigint, v bigint")
    got = running(
        df, F.col("p"), {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))},
        by=["g"], at={"n": F.count(F.lit(1))}, strict=strict, reverse=reverse, widths=(100, 10), bound=bound,
    ).collect()
    assert len(got) == len({(g, p) for g, p, _ in rows})
    for r in got:
        def inside(p):
            ahead = p > r["position"] if reverse else p < r["position"]
            return ahead or (not strict and p == r["position"])

        values = [v for g, p, v in rows if g == r["g"] and inside(p)]
        assert r["n"] == sum(g == r["g"] and p == r["position"] for g, p, _ in rows)
        expected = (sum(values), max(values), min(values)) if values else (None, None, None)
        assert (r["s"], r["hi"], r["lo"]) == expected


def test_hot_groups(spark):
    assert hot_limit(10, 100) == 100
    assert hot_limit(10**12) * MAX_HOT_GROUPS >= 10**12
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(None, 5), (2, 7)], "k bigint, v bigint")
    nulls = spark.createDataFrame([(None,)] * 5 + [(1,)], "k long")
    assert [part.count() for part in split_hot(nulls, ["k"], 6, hot_rows=2)] == [1, 5]
    cold, hot = split_hot(df, ["k"], 12, hot_rows=3)
    assert hot.count() == 10 and sorted(r["v"] for r in cold.collect()) == [5, 7]
    assert split_hot(df, ["k"], 12, hot_rows=12)[1] is None
    for limit in (3, 100):
        minima = {(r["k"], r["m"]) for r in with_group_minimum(df, ["k"], "v", "m", 12, limit).collect()}
        assert minima == {(1, 0), (None, 5), (2, 7)}


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join(spark, direction):
    rng = random.Random(5)
    left = [(rng.choice("ab"), START + rng.randrange(0, 100) * HOUR, i) for i in range(60)] + [("a", None, 99)]
    right = [(rng.choice("ab"), START + h * HOUR, h) for h in rng.sample(range(10, 90), 25)]
    joined = asof_join(
        spark.createDataFrame(left, "g string, t timestamp_ntz, i int"),
        spark.createDataFrame(right, "g string, t timestamp_ntz, h int"),
        "t", ["h"], by=["g"], direction=direction,
    ).collect()
    assert len(joined) == len(left)
    for r in joined:
        if r["t"] is None:
            assert r["h"] is None
            continue
        near = [h for g, t, h in right if g == r["g"] and (t <= r["t"] if direction == "backward" else t >= r["t"])]
        assert r["h"] == ((max(near) if direction == "backward" else min(near)) if near else None)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_sequences(spark, hot_rows):
    rows = random_rows(8, n=50)
    log = make_log(spark, rows)
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    got = {r["event_id"]: r["source_row_number"] for r in source_row_number(log, 50, hot_rows).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    counts = {r["arrival_time"]: r["event_count"] for r in running_event_count(log).collect()}
    marks = {r["arrival_time"]: r["max_event_time"] for r in row_watermark(log).collect()}
    for at in counts:
        assert counts[at] == sum(r[3] <= at for r in rows)
        assert marks[at] == max(r[2] for r in rows if r[3] <= at)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_unique_arrivals(spark, hot_rows):
    from datetime import timedelta

    tick = timedelta(microseconds=1)
    base = [row(i, i, h) for i, h in enumerate([0, 0, 0, 5, 5, 2])]
    # A tie that is bumped past the next arrival pushes that one on too.
    base += [(*r[:3], START + tick, *r[4:]) for r in [row(10, 10, 0)]]
    order = sorted(base, key=lambda r: (r[3], r[0]))
    expected, last = {}, None
    for r in order:
        at = r[3] if last is None or r[3] > last else last + tick
        expected[r[0]], last = at, at
    got = unique_arrivals(make_log(spark, base), hot_rows=hot_rows)
    assert {r["event_id"]: r["arrival_time"] for r in got.collect()} == expected


def test_profile(spark):
    assert profile(make_log(spark, [])).empty
    p = profile(make_log(spark, random_rows(1, n=10)), event_bounds=True)
    assert p.rows == 10 and p.first_arrival <= p.last_arrival and p.first_event is not None


def test_amounts_keep_their_digits(spark):
    rows = spark.createDataFrame([(0.00004, 1), (None, 2)], "amount double, quantity int")
    assert [r[0] for r in rows.select(sales_amount(scale=8)).collect()] == [Decimal("0.00004000"), None]
    with pytest.raises(Exception, match="decimal places"):
        rows.select(sales_amount()).collect()


def test_rows_without_arrival_get_no_number(spark):
    log = make_log(spark, [row(0, 1, None), row(1, 1, 3), row(2, 1, None), row(3, 2, 1)])
    for hot_rows in (1, 10**6):
        numbers = {r.event_id: r.source_row_number for r in source_row_number(log, 4, hot_rows).collect()}
        assert numbers == {3: 1, 1: 2}


def test_scratch_folder(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
    before = session.materialize(spark.range(3))
    assert before.count() == 3 and session.release_scratch(spark)
    with pytest.raises(Exception):
        session.materialize(spark.range(3)).sparkSession.read.parquet(before.inputFiles()[0]).count()
