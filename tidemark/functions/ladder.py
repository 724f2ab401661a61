"""Running aggregates over one global order, without a global window.

An unpartitioned window sends every row to one task.  Here the order axis is cut into slots at a few fixed widths
(a day and a second for microsecond positions).  Each level is totalled from the one below it, a window runs over
the few slots of one parent, and the result enters the next level as a carry row at the head of its slot.  No
window ever holds more rows than its slot has positions, whatever the skew, and no join or sampling is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .clock import DAY, HOUR, SECOND, floor_div

TIME_WIDTHS = (DAY, SECOND)
INDEX_WIDTHS = (1 << 40, 1 << 20)
SMALL_GROUP = 100_000
TASK_ROWS = 1_000_000  # what one window may hold: as many positions as a second has microseconds


def time_widths(rows: int | None) -> tuple[int, int]:
    """Slot widths for microsecond positions, given an upper bound of a group's positions in any hour if there is one.

    Second slots can never hold more than TASK_ROWS positions.  When an hour of the group cannot either, hour slots do,
    with far fewer of them.
    """
    return (DAY, HOUR) if rows is not None and rows <= TASK_ROWS else TIME_WIDTHS


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.last}


def running(
    df: DataFrame,
    position: Column,
    values: Mapping[str, tuple[str, Column]],
    *,
    by: Sequence[str] = (),
    at: Mapping[str, Column] | None = None,
    strict: bool = False,
    reverse: bool = False,
    widths: Sequence[int] = TIME_WIDTHS,
    bound: int | None = None,
    single: bool = False,
) -> DataFrame:
    """One row per (by, position) with running values along the position.

    ``values`` maps an output name to ("sum" | "max" | "min" | "last", column); the output is the aggregate over all rows at
    or before the position (strictly before with ``strict``; from the far end with ``reverse``).  ``at`` holds plain
    aggregates of the rows at the position itself.  "last" is the value at the last position, null or not.  With
    ``single``, the frame has one row per (by, position) already, and needs no first aggregate.
    ``bound`` is a proven upper bound of the positions per group, if there is one; a small one needs no slots.
    """
    by = list(by)
    at = dict(at or {})
    names = list(values)
    slots = [f"_slot{i}" for i in range(len(widths))]
    ordering = [F.col("_order"), F.col("position").desc() if reverse else F.col("position")]

    def total(n: str, source: str) -> Column:
        if values[n][0] == "last":
            return F.min_by(n, source) if reverse else F.max_by(n, source)
        return _COMBINE[values[n][0]](n)

    def totals(rows: DataFrame, keys: list[str], slot: str, width: int, source: str) -> DataFrame:
        return rows.groupBy(*keys, floor_div(F.col(source), width).alias(slot)).agg(*[total(n, source).alias(n) for n in names])

    def scan(rows: DataFrame, keys: list[str], exclusive: bool) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, -1 if exclusive else Window.currentRow
        )
        return rows.select(
            *[c for c in rows.columns if c not in names],
            *[_COMBINE[values[n][0]](n).over(frame).alias(n) for n in names],
        )

    def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
        return rows.withColumn("_order", F.lit(1)).unionByName(
            carry.withColumn("_order", F.lit(0)), allowMissingColumns=True
        )

    # Plain columns before window inputs, as the analyzer orders them below a window: both uses of the points then
    # have the same plan and share one shuffle.
    if single:
        points = df.select(*by, position.alias("position"), *[col.alias(n) for n, col in at.items()], *[col.alias(n) for n, (_, col) in values.items()])
    else:
        points = df.groupBy(*by, position.alias("position")).agg(
            *[col.alias(n) for n, col in at.items()],
            *[(F.max if kind == "last" else _COMBINE[kind])(col).alias(n) for n, (kind, col) in values.items()],
        )

    if bound is not None and bound <= SMALL_GROUP:
        return scan(points.withColumn("_order", F.lit(1)), by, exclusive=strict).select(*by, "position", *at, *names)

    # The totals need no ``at`` columns.  This filter, true for every row, refers to them nonetheless: without it
    # they would be pruned, and the points would be computed and shuffled once more for the totals alone.
    shared = points.filter(F.hash(*at) >= F.lit(-(2**31))) if at and not single else points
    # Totals from fine to coarse; each level is derived from the one below it.
    levels = [totals(shared, by, slots[-1], widths[-1], "position")]
    for i in range(len(widths) - 2, -1, -1):
        levels.insert(0, totals(levels[0], by, slots[i], widths[i] // widths[i + 1], slots[i + 1]))

    top = levels[0].withColumnRenamed(slots[0], "position").withColumn("_order", F.lit(1))
    carry = scan(top, by, exclusive=True).withColumnRenamed("position", slots[0]).drop("_order")
    for i in range(1, len(widths)):
        rows = levels[i].withColumn(slots[i - 1], floor_div(F.col(slots[i]), widths[i - 1] // widths[i]))
        rows = with_carry(rows.withColumnRenamed(slots[i], "position"), carry)
        carry = (
            scan(rows, [*by, slots[i - 1]], exclusive=True)
            .filter(F.col("_order") == 1)
            .drop(slots[i - 1], "_order")
            .withColumnRenamed("position", slots[i])
        )

    rows = with_carry(points.withColumn(slots[-1], floor_div(F.col("position"), widths[-1])), carry)
    return (
        scan(rows, [*by, slots[-1]], exclusive=strict)
        .filter(F.col("_order") == 1)
        .select(*by, "position", *at, *names)
    )
