"""Intervals and points: the points within an interval, and aggregates over all intervals that cover a point.

A running sum forgets a row by subtracting it; a maximum cannot.  So each interval is cut into the nodes of a binary
tree over the numbered points (two for each level at most), nodes are aggregated once, and the values are handed down
from the root to the points.  Work is rows times the tree's height, wherever the intervals lie, and every step is an
aggregate that combines before its shuffle.  An interval that never ends need not be forgotten: it joins a running
maximum instead.  Most rows of a log may have one, and all of them would meet at the number of their common end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ladder import TIME_WIDTHS, running
from ..functions.skew import same_keys
from ..session import materialize

FAR = 1 << 62  # the end of an interval that never ends
HANDED = 4  # levels that one step hands down
BROADCAST_POINTS = 500_000

_COMBINE = {"max": F.max, "min": F.min}


def numbered(points: DataFrame, others: DataFrame, by: Sequence[str], widths: Sequence[int] = TIME_WIDTHS) -> DataFrame:
    """(by, position, is_point, before): how many points lie strictly before each position of ``points`` and ``others``.

    Both hold (by, position); points are distinct.
    """
    both = points.select(*by, "position", F.lit(1).cast("bigint").alias("_n")).unionByName(
        others.select(*by, "position", F.lit(0).cast("bigint").alias("_n"))
    )
    at = {"is_point": F.max("_n") > 0}
    ranks = running(both, F.col("position"), {"before": ("sum", F.col("_n"))}, by=by, at=at, strict=True, widths=widths)
    return ranks.withColumn("before", F.coalesce("before", F.lit(0)))


def _nodes(spans: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, level, node, values) that make up [_lo, _hi); node n of level k covers points n * 2^k up to (n + 1) * 2^k."""
    levels = F.expr("explode(sequence(0, CAST(log2(_hi - _lo) AS INT) + 1))").alias("level")
    cut = spans.filter("_lo < _hi").select(*by, "_lo", "_hi", *names, levels)
    # What finer levels leave over begins and ends at nodes of this level; an odd end is not half of a coarser node.
    first, end = F.expr("shiftright(_lo + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(_hi, level)")
    cut = cut.withColumns({"_first": first, "_end": end}).filter("_first < _end")
    ends = F.expr("filter(array(IF(_first % 2 = 1, _first, NULL), IF(_end % 2 = 1, _end - 1, NULL)), x -> x IS NOT NULL)")
    return cut.select(*by, "level", F.explode(ends).alias("node"), *names)


def _placed(intervals: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intervals (by, _start, _stop, ...) with _lo and _hi: they cover the points number _lo up to _hi."""
    for at, rank in (("_start", "_lo"), ("_stop", "_hi")):
        other = ranks.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("position").alias(f"_of_{at}"), F.col("before").alias(rank))
        intervals = intervals.join(other, same_keys(intervals, other, [*by, at], "_of_")).select(*intervals.columns, rank)
    return intervals


def points_within(
    intervals: DataFrame,
    points: DataFrame,
    start: Column,
    end: Column,
    *,
    by: Sequence[str] = (),
    widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """A row of ``intervals`` and ``position`` for each point in [start, end); a null end is open.

    ``points`` hold distinct (by, position), at irregular distances.  The ends of all intervals and the points are
    numbered along one order; an interval then lists the numbers it covers, and each number is looked up.  So work is
    linear in rows and matches, whatever the lengths of the intervals; no bin width has to be chosen.
    """
    by = list(by)
    spans = intervals.withColumns({"_start": start, "_stop": F.coalesce(end, F.lit(FAR))}).filter("_start < _stop")
    spans = materialize(spans, "spans")
    ends = spans.select(*by, F.explode(F.array("_start", "_stop")).alias("position")).distinct()
    ranks = materialize(numbered(points, ends, by, widths), "ranks")
    spans = _placed(spans, ranks, by).filter("_lo < _hi").withColumn("_number", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    own = points.select(*by, "position").join(ranks, [*by, "position"])
    own = own.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("before").alias("_of__number"), "position")
    if points.count() <= BROADCAST_POINTS:
        own = F.broadcast(own)
    return spans.join(own, same_keys(spans, own, [*by, "_number"], "_of_")).select(*intervals.columns, "position")


def point_counts(
    intervals: DataFrame,
    points: DataFrame,
    start: Column,
    end: Column,
    keys: Sequence[str],
    *,
    by: Sequence[str] = (),
    widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """(keys, points, first): how many points the intervals [start, end) of each key hold together, and the first one.

    ``points`` hold distinct (by, position); a null end is open; keys without a point are left out.  A running count
    from the far end says for each end how many points follow it and which one is next.  The points of an interval are
    a difference of two such numbers, so no row is made for a point within it; an open end needs no number at all.
    """
    by, keys = list(by), list(keys)
    ends = F.array(
        F.struct(start.alias("position"), F.lit(1).cast("bigint").alias("_sign"), end.alias("_until")),
        F.struct(end.alias("position"), F.lit(-1).cast("bigint").alias("_sign"), F.lit(None).cast("bigint").alias("_until")),
    )
    ends = intervals.filter(start.isNotNull() & (end.isNull() | (start < end))).select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *by, F.explode(ends).alias("_e")
    )
    ends = materialize(ends.select("*", "_e.*").drop("_e").filter("position IS NOT NULL"), "ends")
    both = points.select(*by, "position", F.lit(1).cast("bigint").alias("_n"), F.col("position").alias("_at")).unionByName(
        ends.select(*by, "position", F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("bigint").alias("_at"))
    )
    after = running(
        both, F.col("position"), {"_after": ("sum", F.col("_n")), "_next": ("min", F.col("_at"))}, by=by, reverse=True, widths=widths
    ).withColumnsRenamed({c: f"_of_{c}" for c in [*by, "position"]})
    found = ends.join(after, same_keys(ends, after, [*by, "position"], "_of_"))
    first = (F.col("_sign") == 1) & (F.col("_until").isNull() | (F.col("_next") < F.col("_until")))
    counts = found.groupBy(*[f"_key{i}" for i in range(len(keys))]).agg(
        F.sum(F.col("_sign") * F.col("_after")).alias("points"), F.min(F.when(first, F.col("_next"))).alias("first")
    )
    return counts.filter("points > 0").withColumnsRenamed({f"_key{i}": k for i, k in enumerate(keys)})


def covering(
    intervals: DataFrame,
    points: DataFrame,
    start: Column,
    end: Column,
    values: Mapping[str, tuple[str, Column]],
    *,
    by: Sequence[str] = (),
    widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """(by, position, values) of the points that some interval [start, end) covers.

    ``values`` maps an output name to ("max" | "min", column); null values do not count, a null end is open.
    ``points`` hold distinct (by, position).  Intervals with the same ends are combined first, so ends that very many
    rows share are no burden; the tree has no node that more rows meet in than combine before the shuffle.
    """
    by, names = list(by), list(values)
    aggregates = [_COMBINE[kind](n).alias(n) for n, (kind, _) in values.items()]
    spans = intervals.select(*by, start.alias("_start"), end.alias("_stop"), *[c.alias(n) for n, (_, c) in values.items()])
    spans = spans.filter("_start IS NOT NULL AND (_stop IS NULL OR _start < _stop)")
    spans = materialize(spans.groupBy(*by, "_start", "_stop").agg(*aggregates), "spans")
    endless, spans = spans.filter("_stop IS NULL").drop("_stop"), spans.filter("_stop IS NOT NULL")

    ends = spans.select(*by, F.explode(F.array("_start", "_stop")).alias("position"))
    ranks = materialize(numbered(points, ends, by, widths), "ranks")
    spans = _placed(spans, ranks, by)
    nodes = materialize(_nodes(spans, by, names).groupBy(*by, "level", "node").agg(*aggregates), "nodes")

    top = nodes.agg(F.max("level")).first()[0]  # one number
    handed = None
    for base in range((top or 0) // HANDED * HANDED, -1, -HANDED):
        here = nodes.filter(F.col("level").between(base, base + HANDED - 1))
        here = here if handed is None else here.unionByName(handed)
        down = F.expr(f"explode(sequence(shiftleft(node, level - {base}), shiftleft(node + 1, level - {base}) - 1))")
        here = here.select(*by, down.alias("_at"), *names).withColumnRenamed("_at", "node")
        if base:
            handed = here.groupBy(*by, "node").agg(*aggregates).withColumn("level", F.lit(base))
    # The last step takes the points in as well.  A join with them would be planned by the size of the few nodes before
    # they are handed down, so it would broadcast what comes of these: as many rows as there are points.
    own = ranks.filter("is_point AND position IS NOT NULL").select(*by, F.col("before").alias("node"), "position")
    met = here.withColumn("_covered", F.lit(True)).unionByName(own, allowMissingColumns=True)
    covered = met.groupBy(*by, "node").agg(
        F.max("position").alias("position"), F.max("_covered").alias("_covered"), *[_COMBINE[kind](n).alias(f"_tree_{n}") for n, (kind, _) in values.items()]
    ).filter("_covered AND position IS NOT NULL").drop("node")

    # The values from the tree wait at their points, so both kinds of intervals meet without a step of their own.
    begun = endless.withColumnRenamed("_start", "position").withColumn("_begun", F.lit(True))
    asked = points.select(*by, "position", F.lit(True).alias("_asked"))
    reached = running(
        begun.unionByName(asked, allowMissingColumns=True).unionByName(covered, allowMissingColumns=True),
        F.col("position"),
        {**{n: (kind, F.col(n)) for n, (kind, _) in values.items()}, "_begun": ("max", F.col("_begun"))},
        by=by,
        at={"_asked": F.max("_asked"), "_covered": F.max("_covered"), **{f"_tree_{n}": F.max(f"_tree_{n}") for n in names}},
        widths=widths,
    ).filter("_asked AND (_begun OR _covered)")
    better = {"max": F.greatest, "min": F.least}
    return reached.select(*by, "position", *[better[kind](F.col(n), F.col(f"_tree_{n}")).alias(n) for n, (kind, _) in values.items()])


def distinct_counts(
    rows: DataFrame,
    points: DataFrame,
    start: Column,
    end: Column,
    value: Column,
    name: str,
    *,
    by: Sequence[str] = (),
    widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """(by, position, name) at every point: how many different values the intervals that cover it have.

    Each value counts its references: it appears when they rise from zero and disappears when they fall back.  Only
    these moves go on into the sum along the points.  A value that most rows have is no burden: its references are
    summed by slots of time, and equal times combine before the shuffle.  Nulls are not counted.
    """
    by = list(by)
    moves = F.array(
        F.struct(start.alias("position"), F.lit(1).cast("bigint").alias("_n")),
        F.struct(end.alias("position"), F.lit(-1).cast("bigint").alias("_n")),
    )
    moves = rows.filter(start.isNotNull() & (end.isNull() | (start < end)) & value.isNotNull()).select(
        *by, value.alias("_value"), F.explode(moves).alias("_m")
    )
    moves = moves.select(*by, "_value", "_m.*").filter("position IS NOT NULL")
    references = running(
        moves, F.col("position"), {"_after": ("sum", F.col("_n"))}, by=[*by, "_value"], at={"_n": F.sum("_n")}, widths=widths
    )
    step = (F.col("_after") > 0).cast("bigint") - (F.col("_after") - F.col("_n") > 0).cast("bigint")
    steps = references.select(*by, "position", step.alias("_step")).filter("_step <> 0")
    asked = points.select(*by, "position", F.lit(True).alias("_asked"))
    counts = running(
        steps.unionByName(asked, allowMissingColumns=True),
        F.col("position"),
        {name: ("sum", F.col("_step"))},
        by=by,
        at={"_asked": F.max("_asked")},
        widths=widths,
    )
    return counts.filter("_asked").select(*by, "position", F.coalesce(name, F.lit(0)).alias(name))
