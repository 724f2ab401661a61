"""As-of joins: each left row takes the nearest right row before or after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import to_micros, to_timestamp
from ..functions.ladder import running, time_widths
from ..functions.skew import same_keys


def lookup_as_of(
    points: DataFrame,
    right: DataFrame,
    on: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    direction: str = "backward",
    rows: int | None = None,
) -> DataFrame:
    """(by, on, values) for each distinct point: the right row at or before it ("forward": at or after it).

    A point without such a row gets nulls.  Of right rows with one time, the greatest values win.  The times of both
    sides enter one running maximum along the time axis (there is no range join); the values come by an equi-join.  ``rows`` is an upper bound of the rows of both sides
    per group, if known.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    forward = direction == "forward"
    marked = right.filter(F.col(on).isNotNull()).select(*by, to_micros(on).alias("_at"), *values)
    both = marked.select(*by, "_at", F.col("_at").alias("_near"), F.lit(False).alias("_asked")).unionByName(
        points.filter(F.col(on).isNotNull()).select(*by, to_micros(on).alias("_at"), F.lit(True).alias("_asked")),
        allowMissingColumns=True,
    )
    found = running(
        both,
        F.col("_at"),
        {"_near": ("min" if forward else "max", F.col("_near"))},
        by=by,
        at={"_asked": F.max("_asked")},
        reverse=forward,
        widths=time_widths(rows),
    )
    found = found.filter("_asked")
    # One plain value aggregates by hash; several need a struct to stay together.
    most = F.max(values[0]) if len(values) == 1 else F.max(F.struct(*values))
    best = marked.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_at").alias("_of__near")).agg(most.alias("_row"))
    joined = found.join(best, same_keys(found, best, [*by, "_near"], "_of_"), "left")
    picked = [F.col("_row").alias(values[0])] if len(values) == 1 else [F.col("_row")[v].alias(v) for v in values]
    return joined.select(*by, to_timestamp("position").alias(on), *picked)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    direction: str = "backward",
    rows: int | None = None,
) -> DataFrame:
    """Left rows with the values of the nearest right row; left times may repeat or be null."""
    found = lookup_as_of(left, right, on, values, by, direction, rows)
    condition: Column = F.lit(True)
    for c in [*by, on]:
        condition = condition & left[c].eqNullSafe(found[c])
    return left.join(found, condition, "left").select(*[left[c] for c in left.columns], *[found[v] for v in values])
