"""Row numbers, running counts and watermarks over the arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import to_micros, to_timestamp
from ..functions.ladder import INDEX_WIDTHS, running, time_widths
from ..functions.skew import HOT_ROWS, split_hot


def running_event_count(log: DataFrame, rows: int | None = None) -> DataFrame:
    """(arrival_time, event_count): rows that arrived at or before each distinct arrival."""
    one = F.lit(1).cast("bigint")
    counts = running(log, to_micros("arrival_time"), {"event_count": ("sum", one)}, widths=time_widths(rows))
    return counts.select(to_timestamp("position").alias("arrival_time"), "event_count")


def row_watermark(log: DataFrame, rows: int | None = None) -> DataFrame:
    """(arrival_time, max_event_time): newest event time seen up to each arrival, all rows of that arrival included."""
    newest = {"max_event_time": ("max", F.col("event_time"))}
    marks = running(log, to_micros("arrival_time"), newest, widths=time_widths(rows))
    return marks.select(to_timestamp("position").alias("arrival_time"), "max_event_time")


def source_row_number(log: DataFrame, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(event_id, arrival_us, source_row_number) by (arrival_time, event_id), counted from 1.

    Rows without an arrival get no number.  The rows before an arrival are a running count; within one arrival the rows are numbered by event_id.  Arrivals
    shared by more rows than a task should hold are numbered by a second running count along event_id.
    """
    keyed = log.filter(F.col("arrival_time").isNotNull()).select("event_id", to_micros("arrival_time").alias("arrival_us"))
    one = F.lit(1).cast("bigint")
    before = running(keyed, F.col("arrival_us"), {"before": ("sum", one)}, strict=True, widths=time_widths(rows)).select(
        F.col("position").alias("arrival_us"), F.coalesce("before", F.lit(0)).alias("before")
    )
    cold, hot = split_hot(keyed, ["arrival_us"], rows, hot_rows)
    # The count before an arrival enters its group as a head row, so no join is needed.
    order = Window.partitionBy("arrival_us").orderBy("_order", "event_id")
    heads = before.select(
        F.lit(None).cast("bigint").alias("event_id"), "arrival_us", F.col("before").alias("_n"), F.lit(0).alias("_order")
    )
    numbered = (
        cold.select("event_id", "arrival_us", one.alias("_n"), F.lit(1).alias("_order"))
        .unionByName(heads)
        .select("event_id", "arrival_us", "_order", F.sum("_n").over(order).alias("source_row_number"))
        .filter(F.col("_order") == 1)
        .drop("_order")
    )
    if hot is None:
        return numbered
    within = running(
        hot, F.col("event_id"), {"_n": ("sum", one)}, by=["arrival_us"], widths=INDEX_WIDTHS
    ).withColumnRenamed("position", "event_id")
    tied = within.join(before, "arrival_us").select(
        "event_id", "arrival_us", (F.col("_n") + F.col("before")).alias("source_row_number")
    )
    return numbered.unionByName(tied)
