"""Refreshes at the times of a calendar, at irregular distances, each of which reads back as far as it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import hours, to_micros, to_timestamp
from ..functions.ladder import running, time_widths
from ..functions.measures import as_total, is_live, sales_amount
from ..functions.skew import HOT_ROWS, same_keys, split_hot
from .spans import point_counts, points_within
from .views import KEY

CALENDAR_DDL = "at timestamp_ntz, full boolean"


def versions(log: DataFrame, rows: int, key: str = KEY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """event_id, live, amount, arrival_us, next_arrival_us of the rows with an arrival; ties of a key end at once."""
    plain = log.filter(F.col("arrival_time").isNotNull()).select(
        "event_id", key, is_live().alias("live"), sales_amount().alias("amount"), to_micros("arrival_time").alias("arrival_us")
    )
    cold, hot = split_hot(plain, [key], rows, hot_rows)
    newest_first = Window.partitionBy(key).orderBy(F.col("arrival_us").desc(), F.col("event_id").desc())
    found = cold.withColumn("next_arrival_us", F.lag("arrival_us").over(newest_first))
    if hot is not None:
        # Of the rows that share an arrival the one with the highest event_id is newer than the others.
        after = running(
            hot, F.col("arrival_us"), {"_next": ("min", F.col("arrival_us"))}, by=[key], at={"_top": F.max("event_id")},
            strict=True, reverse=True, widths=time_widths(rows),
        ).withColumnsRenamed({key: f"_of_{key}", "position": "_of_arrival_us"})
        hot = hot.join(after, same_keys(hot, after, [key, "arrival_us"], "_of_"))
        ends = F.when(F.col("event_id") == F.col("_top"), F.col("_next")).otherwise(F.col("arrival_us"))
        found = found.unionByName(hot.select(*plain.columns, ends.alias("next_arrival_us")))
    return found.drop(key)


def _times(calendar: DataFrame) -> DataFrame:
    """(position, full): the distinct times of the refreshes."""
    at = to_micros("at")
    return calendar.filter(F.col("at").isNotNull()).groupBy(at.alias("position")).agg(F.max(F.coalesce("full", F.lit(False))).alias("full"))


def _spans(log: DataFrame, hot: float, rows: int, key: str, hot_rows: int) -> DataFrame:
    """(event_id, amount, arrival_us, full, until): the times at which a refresh loads a live row, for either kind."""
    live = versions(log, rows, key, hot_rows).filter("live")
    leaves = F.col("arrival_us") + F.lit(hours(hot) + 1)
    # One pass: an interval for the hot refreshes and a longer one for the full ones.
    reaches = F.array(
        F.struct(F.lit(False).alias("full"), F.least(leaves, F.coalesce("next_arrival_us", leaves)).alias("until")),
        F.struct(F.lit(True).alias("full"), F.col("next_arrival_us").alias("until")),
    )
    return live.select("event_id", "amount", "arrival_us", F.explode(reaches).alias("_r")).select("*", "_r.*").drop("_r")


def calendar_loads(log: DataFrame, calendar: DataFrame, hot: float, rows: int, key: str = KEY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(event_id, amount, at): each live row and each refresh that loads it.

    ``calendar`` holds the refreshes: ``at`` (repeated and null times count once and not at all) and ``full``.  A
    refresh reads the arrivals of the ``hot`` hours before it, both ends included, or all if it is full; of what it
    reads it loads the newest row of each key.  So a row is loaded by the refreshes from its arrival on, until a newer
    change of its key arrives, and until it leaves the hot window unless they are full.  ``rows``: an upper bound of
    the log's rows.

    These are rows times full refreshes: ``calendar_load_counts`` and ``calendar_refresh_totals`` do without them.
    """
    spans = _spans(log, hot, rows, key, hot_rows)
    found = points_within(spans, _times(calendar), F.col("arrival_us"), F.col("until"), by=["full"], widths=time_widths(None))
    return found.select("event_id", "amount", to_timestamp("position").alias("at"))


def calendar_load_counts(
    log: DataFrame, calendar: DataFrame, hot: float, rows: int, key: str = KEY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``load_counts`` of ``calendar_loads``, from the numbers of the refreshes at the ends of each row's interval."""
    spans = _spans(log, hot, rows, key, hot_rows)
    found = point_counts(spans, _times(calendar), F.col("arrival_us"), F.col("until"), ["event_id"], by=["full"], widths=time_widths(None))
    return found.select("event_id", F.col("points").alias("load_count"), to_timestamp("first").alias("first_loaded"))


def calendar_refresh_totals(
    log: DataFrame, calendar: DataFrame, hot: float, rows: int, key: str = KEY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``refresh_totals`` of ``calendar_loads``, as running sums of the rows that come within reach and go out of it."""
    spans = _spans(log, hot, rows, key, hot_rows).filter("until IS NULL OR arrival_us < until")
    moves = F.array(
        F.struct(F.col("arrival_us").alias("position"), F.lit(1).cast("bigint").alias("_n"), F.col("amount").alias("_amount")),
        F.struct(F.col("until").alias("position"), F.lit(-1).cast("bigint").alias("_n"), (-F.col("amount")).alias("_amount")),
    )
    moves = spans.select("full", F.explode(moves).alias("_m")).select("full", "_m.*").filter("position IS NOT NULL")
    asked = _times(calendar).select("full", "position", F.lit(True).alias("_asked"))
    totals = running(
        moves.unionByName(asked, allowMissingColumns=True),
        F.col("position"),
        {"_rows": ("sum", F.col("_n")), "_sales": ("sum", F.col("_amount"))},
        by=["full"],
        at={"_asked": F.max("_asked")},
        widths=time_widths(None),
    ).filter("_asked")
    return totals.select(
        to_timestamp("position").alias("at"), F.coalesce("_rows", F.lit(0)).alias("loaded_rows"), as_total(F.col("_sales")).alias("loaded_sales")
    )


def load_counts(loads: DataFrame) -> DataFrame:
    """event_id, load_count, first_loaded: how often each row is written, and when readers see it first."""
    return loads.groupBy("event_id").agg(F.count("*").alias("load_count"), F.min("at").alias("first_loaded"))


def refresh_totals(loads: DataFrame, calendar: DataFrame) -> DataFrame:
    """at, loaded_rows, loaded_sales of every refresh, those that load nothing included."""
    totals = loads.groupBy("at").agg(F.count("*").alias("loaded_rows"), F.sum("amount").alias("amount"))
    times = calendar.filter(F.col("at").isNotNull()).select("at").distinct()
    return times.join(totals, "at", "left").select(
        "at", F.coalesce("loaded_rows", F.lit(0)).alias("loaded_rows"), as_total(F.col("amount")).alias("loaded_sales")
    )
