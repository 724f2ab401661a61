"""Measures over served rows.

An additive measure is one column expression per row; its sum is maintained along a timeline.  Sums run over
decimals, so a running sum equals the direct sum exactly.  ``Largest``, ``Smallest`` and ``DistinctCount`` run along a
timeline too, although rows cannot be subtracted from them.  A snapshot measure is a function from a served DataFrame
to a DataFrame and is summarised to one value per snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

SnapshotMeasure = Callable[[DataFrame], DataFrame]


AMOUNT_DIGITS, AMOUNT_SCALE = 18, 4


def exact_decimal(name: str, digits: int = AMOUNT_DIGITS, scale: int = AMOUNT_SCALE) -> Column:
    """A number as a decimal; raises where the decimal would lose digits of it, or has no room for it."""
    value, exact = F.col(name), F.col(name).cast(f"decimal({digits},{scale})")
    lost = F.raise_error(F.concat(F.lit(f"{name} has more than {scale} decimal places: "), value.cast("string")))
    return F.when(exact.cast("double") == value.cast("double"), exact).when(value.isNotNull(), lost.cast(f"decimal({digits},{scale})"))


def sales_amount(digits: int = AMOUNT_DIGITS, scale: int = AMOUNT_SCALE) -> Column:
    """amount * quantity, exact for amounts of ``scale`` decimal places and ``digits`` digits in all; raises beyond."""
    return exact_decimal("amount", digits, scale) * F.col("quantity")


def is_live() -> Column:
    """Not a tombstone; an unknown flag counts as deleted, as in ``is_deleted = FALSE``."""
    return F.coalesce(~F.col("is_deleted"), F.lit(False))


def as_total(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Largest:
    """The greatest value of a column among the served rows; no value where there is none."""

    column: Column
    label: str = "Largest"


@dataclass(frozen=True)
class Smallest:
    """The least value of a column among the served rows; no value where there is none."""

    column: Column
    label: str = "Smallest"


@dataclass(frozen=True)
class DistinctCount:
    """How many different values of a column the served rows have; nulls are not counted."""

    column: Column
    label: str = "Distinct Count"


ADDITIVE_MEASURES: Mapping[str, Callable[[], Column]] = {"total_sales": sales_amount}
MEASURE_LABELS: Mapping[str, str] = {"total_sales": "Total Sales"}


def by_value(column: str, values: Sequence[str], name: str = "total_sales") -> dict[str, Column]:
    """One additive measure for each of the values of a dimension: a timeline then has a row for each of them."""
    measure = ADDITIVE_MEASURES[name]()
    return {f"{name}:{v}": F.when(F.col(column) == v, measure) for v in values}


def ratio_metric(timeline: DataFrame, name: str, over: str, under: str, label: str) -> DataFrame:
    """A derived metric along a timeline, such as an average: one metric's value over another's, null over zero."""
    keys = [c for c in timeline.columns if c not in ("metric", "value", "value_label")]
    parts = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in ((over, "_over"), (under, "_under"))]
    rows = timeline.filter(F.col("metric").isin(over, under)).groupBy(*keys).agg(*parts)
    value = F.when(F.col("_under") != 0, F.col("_over") / F.col("_under"))
    return rows.select(
        *[
            {"metric": F.lit(name), "value": value, "value_label": F.lit(label)}.get(c, F.col(c)).alias(c)
            for c in timeline.columns
        ]
    )


def total_sales(served: DataFrame) -> DataFrame:
    return served.filter(is_live()).agg(
        as_total(F.sum(sales_amount())).alias("total_sales"),
        F.count(F.lit(1)).alias("event_count"),
    )


def max_visible_arrival(served: DataFrame) -> DataFrame:
    return served.agg(F.max("arrival_time").alias("max_visible_arrival_time"))


SNAPSHOT_MEASURES: Mapping[str, SnapshotMeasure] = {"total_sales": total_sales}


def summarize_measure(name: str, snapshot: DataFrame) -> DataFrame:
    """One row (metric, value, value_label[, period_start, period_end]) that stands for a measure's output.

    The value is the ``value`` column if there is one, else the total of ``total_sales`` for that measure, else the
    mean of the first numeric column that is neither an id nor a counter.  It is null for an empty input.
    """
    columns = snapshot.columns
    label: str | None
    if "value" in columns:
        value, label = F.first("value").cast("double"), "Value"
    elif name == "total_sales" and "total_sales" in columns:
        value, label = F.sum("total_sales").cast("double"), "Total Sales"
    else:
        numeric = [
            f.name
            for f in snapshot.schema.fields
            if isinstance(f.dataType, T.NumericType)
            and not f.name.endswith("_id")
            and f.name not in ("event_count", "revenue_rank")
        ]
        label = numeric[0] if numeric else None
        value = F.avg(numeric[0]).cast("double") if numeric else F.first(F.lit(None).cast("double"))
    periods = [F.first(c).alias(c) for c in ("period_start", "period_end") if c in columns]
    return snapshot.agg(value.alias("value"), *periods).select(
        F.lit(name).alias("metric"),
        "value",
        F.when(F.col("value").isNotNull(), F.lit(label)).alias("value_label"),
        *[c for c in ("period_start", "period_end") if c in columns],
    )


def capture(
    served: DataFrame, measures: Mapping[str, SnapshotMeasure] = SNAPSHOT_MEASURES
) -> DataFrame:
    """All measures of one served state, one row each; measures without a value are left out."""
    out = None
    for name, measure in measures.items():
        row = summarize_measure(name, measure(served)).filter(F.col("value").isNotNull())
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
