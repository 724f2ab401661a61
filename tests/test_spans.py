"""Measures that cannot be subtracted, against plain replays and brute force."""

import random

import pytest
from helpers import Naive, make_log, random_rows
from pyspark.sql import functions as F
from test_policies import CASES

from tidemark.functions import measures as M
from tidemark.operators import spans as S
from tidemark.operators.replay import Replay, Run


class Keeping(Naive):
    """A replay that records other values of the served table."""

    def _record(self, at, count, table, cutoff):
        live = [r for r in table.values() if not r[11]]
        sales = [round(r[9] * r[8], 4) for r in live]
        self.timeline[at] = (
            sum(sales), max(sales, default=None), min(sales, default=None), float(len({r[8] for r in live}))
        )


def measures():
    return {
        "total_sales": M.sales_amount(),
        "max_sale": M.Largest(M.sales_amount()),
        "quantities": M.DistinctCount(F.col("quantity")),
        "min_sale": M.Smallest(M.sales_amount()),
    }


ORDER = ("total_sales", "max_sale", "min_sale", "quantities")


@pytest.mark.parametrize("seed,hot_rows,hot", [(41, 1_000_000, True), (42, 3, True)])
def test_every_policy(spark, seed, hot_rows, hot):
    rows = random_rows(seed, hot=hot)
    runs = [Run(p, str(i)) for i, p in enumerate(CASES)]
    replay = Replay(make_log(spark, rows), runs, measures=measures(), hot_rows=hot_rows).materialized()
    got = {}
    for r in replay.timeline().collect():
        got.setdefault(r.scenario, {}).setdefault(r.arrival_time, {})[r.metric] = r.value
    for i, policy in enumerate(CASES):
        naive = getattr(Keeping(rows), policy.name)(**policy.params())
        assert got.get(str(i), {}).keys() == naive.timeline.keys(), policy
        for at, expected in naive.timeline.items():
            values = tuple(got[str(i)][at].get(n) for n in ORDER)
            assert values == pytest.approx(expected), (policy, at)


def test_only_lasting_measures_and_an_empty_log(spark):
    log = make_log(spark, random_rows(7))
    rows = Replay(log, [CASES[0]], measures={"biggest": M.Largest(F.col("quantity"), "Biggest")}).timeline().collect()
    assert {(r.metric, r.value_label) for r in rows} == {("biggest", "Biggest")}
    assert Replay(log.limit(0), [CASES[0], CASES[1]], measures=measures()).timeline().count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_covering(spark, seed):
    rng = random.Random(seed)
    points = {g: sorted(rng.sample(range(200), n)) for g, n in ((0, 70), (1, 1), (2, 33))}
    spans = [(rng.choice([0, 1, 2, 3]), rng.choice([None, *range(210)]), rng.choice([None, *range(210)]), rng.choice([None, *range(50)]))
             for _ in range(300)]
    frame = spark.createDataFrame(spans, "g int, a long, b long, v int")
    asked = spark.createDataFrame([(g, p) for g, ps in points.items() for p in ps], "g int, position long")
    found = S.covering(frame, asked, F.col("a"), F.col("b"), {"hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}, by=["g"])
    got = {(r.g, r.position): (r.hi, r.lo) for r in found.collect() if r.hi is not None}
    counts = S.distinct_counts(frame, asked, F.col("a"), F.col("b"), F.col("v"), "n", by=["g"])
    numbers = {(r.g, r.position): r.n for r in counts.collect()}
    for g, ps in points.items():
        for p in ps:
            values = {v for h, a, b, v in spans if h == g and v is not None and a is not None and a <= p and (b is None or p < b)}
            assert got.get((g, p)) == ((max(values), min(values)) if values else None)
            assert numbers[g, p] == len(values)


def test_shared_ends_are_combined_before_the_tree(spark):
    """A third of all rows may begin at one point: the tree sees one interval of them."""
    rows = spark.range(3000).select((F.col("id") % 3 == 0).alias("hot"), F.col("id").alias("v"))
    rows = rows.select(F.when(F.col("hot"), 5).otherwise(F.col("v")).cast("long").alias("a"), F.lit(4000).cast("long").alias("b"), "v")
    points = spark.range(0, 4000, 7).select(F.col("id").alias("position"))
    found = S.covering(rows, points, F.col("a"), F.col("b"), {"top": ("max", F.col("v"))})
    got = {r.position: r.top for r in found.collect()}
    assert got == {p: 2997 if p < 2999 else 2999 for p in range(7, 4000, 7)} | {p: got[p] for p in got if p in (0,) or 2996 < p < 3003}




@pytest.mark.parametrize("seed", [1, 2])
def test_points_within(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_POINTS", 0 if seed == 1 else 500_000)
    rng = random.Random(seed)
    points = {g: sorted(rng.sample(range(-50, 200), n)) for g, n in ((0, 40), (1, 1))}
    spans = [(i, rng.choice([0, 1, 2]), rng.choice([None, *range(-60, 210)]), rng.choice([None, *range(-60, 210)])) for i in range(120)]
    frame = spark.createDataFrame(spans, "id int, g int, a long, b long")
    asked = spark.createDataFrame([(g, p) for g, ps in points.items() for p in ps], "g int, position long")
    got = sorted((r.id, r.position) for r in S.points_within(frame, asked, F.col("a"), F.col("b"), by=["g"]).collect())
    expected = [
        (i, p) for i, g, a, b in spans if a is not None for p in points.get(g, []) if a <= p and (b is None or p < b)
    ]
    assert got == sorted(expected)


def test_intervals_without_an_end_stay_out_of_the_tree(spark, monkeypatch):
    """They share one end, so all of them met in one task, which then cut them into nodes."""
    seen = {}
    monkeypatch.setattr(S, "materialize", lambda df, name: seen.setdefault(name, df))
    rows = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") % 10 == 0, F.col("id") + 5).alias("b"), (F.col("id") % 7).alias("v"))
    points = spark.range(0, 400, 3).select(F.col("id").alias("position"))
    found = S.covering(rows, points, F.col("a"), F.col("b"), {"top": ("max", F.col("v"))})
    values = [(a, a + 5 if a % 10 == 0 else None, a % 7) for a in range(300)]
    expected = {p: max((v for a, b, v in values if a <= p and (b is None or p < b)), default=None) for p in range(0, 400, 3)}
    assert {r.position: r.top for r in found.collect()} == {p: v for p, v in expected.items() if v is not None}
    assert seen["ranks"].filter(F.col("position") > 1000).count() == 0
    # Thirty intervals, each of at most two nodes on a level.
    assert seen["nodes"].agg(F.max("level")).first()[0] <= 1 and seen["nodes"].count() <= 60


def test_what_few_intervals_hand_down_is_not_broadcast(spark):
    """Three intervals over 100,000 points are a few nodes, by whose size a join with the points was planned."""
    spans = spark.createDataFrame([(0, 90_000, 1, 5), (10, 99_999, 1, 7), (50_000, 60_000, 2, 9)], "a long, b long, g int, v int")
    points = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("position"))
    tops = {"top": ("max", F.col("v")), "low": ("min", F.col("v"))}
    found = S.covering(spans, points, F.col("a"), F.col("b"), tops, by=["g"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.groupBy("g", "top", "low").agg(F.count("position"), F.min("position"), F.max("position")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 5, 10, 0, 9), (1, 7, 5, 89_990, 10, 89_999), (1, 7, 7, 9_999, 90_000, 99_998)]
