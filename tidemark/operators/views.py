"""Latest-state and as-of views of a change log, and the truths read from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import DAY, HOUR, datetime_of, micros_of, ntz
from ..functions.measures import as_total, is_live, sales_amount

KEY = "sale_id"


def as_of(log: DataFrame, at: datetime | str | None, column: str = "arrival_time") -> DataFrame:
    """Rows at or before a time.  It must come before the latest-per-key step, where it also reaches the scan."""
    return log if at is None else log.filter(F.col(column) <= ntz(at))


def arrived_between(log: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Closed arrival range [start, end]."""
    return log.filter(F.col("arrival_time").between(ntz(start), ntz(end)))


def increment(log: DataFrame, last: datetime | str | None, cutoff: datetime | str) -> DataFrame:
    """Rows that arrived in (last, cutoff]; everything up to the cutoff when there was no last one."""
    rows = as_of(log, cutoff)
    return rows if last is None else rows.filter(F.col("arrival_time") > ntz(last))


def in_period(rows: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Half-open business period [start, end) on event_time."""
    return rows.filter((F.col("event_time") >= ntz(start)) & (F.col("event_time") < ntz(end)))


def changed_keys(log: DataFrame, key: str = KEY) -> DataFrame:
    return log.select(key).distinct()


def latest_per(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order values per key.

    ``max_by`` keeps one row per key on the map side already, so a key with very many rows costs one row per task
    in the shuffle.
    """
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in log.columns])


def latest_rows(log: DataFrame, at: datetime | str | None = None, key: str = KEY) -> DataFrame:
    """Newest change per key by (arrival_time, event_id), tombstones included."""
    return latest_per(as_of(log, at).filter(F.col("arrival_time").isNotNull()), [key], ["arrival_time", "event_id"])


def snapshot_as_of(log: DataFrame, at: datetime | str | None = None, key: str = KEY) -> DataFrame:
    """State as of a time: newest change per key, deleted keys left out.

    The tombstone filter comes last: before it, a deleted key would come back with its previous row.
    """
    return latest_rows(log, at, key).filter(is_live())


def observed_log(log: DataFrame, key: str = KEY) -> DataFrame:
    """One row per (key, arrival_time): the one with the highest event_id."""
    return latest_per(log, [key, "arrival_time"], ["event_id"])


def observation_grid(log: DataFrame, at: datetime | str | None = None) -> DataFrame:
    """Distinct arrivals up to a time."""
    return as_of(log, at).filter(F.col("arrival_time").isNotNull()).select("arrival_time").distinct()


def served_value(rows: DataFrame, measure: Column | None = None) -> DataFrame:
    """Total of a served state (or of a period of it) and its row count."""
    measure = sales_amount() if measure is None else measure
    return rows.filter(is_live()).agg(
        as_total(F.sum(measure)).alias("total_sales"), F.count(F.lit(1)).alias("active_row_count")
    )


def truth_total(log: DataFrame, at: datetime | str | None = None) -> DataFrame:
    return served_value(snapshot_as_of(log, at)).select("total_sales")


def truth_period(
    log: DataFrame, start: datetime | str, end: datetime | str, at: datetime | str | None = None
) -> DataFrame:
    """Truth over a business period: the period is cut from the latest rows, never from the log."""
    return served_value(in_period(snapshot_as_of(log, at), start, end))


def closed_window(at: datetime | str, window_hours: float, delay_hours: float = 0.0) -> tuple[datetime, datetime]:
    """[start, end) of the window that closed ``delay_hours`` before a time."""
    end = micros_of(at) - round(delay_hours * HOUR)
    return datetime_of(end - round(window_hours * HOUR)), datetime_of(end)


def daily_window(at: datetime | str, delay_hours: float = 0.0) -> tuple[datetime, datetime]:
    return closed_window(at, DAY / HOUR, delay_hours)


def weekly_window(at: datetime | str, delay_hours: float = 0.0) -> tuple[datetime, datetime]:
    return closed_window(at, 7 * DAY / HOUR, delay_hours)


def committed_snapshot(log: DataFrame, commits: DataFrame, key: str = KEY) -> DataFrame:
    """State as of the newest commit of a commits table; empty before the first one."""
    cutoff = commits.agg(F.max("commit_cutoff")).scalar()  # a filter value at run time, so it reaches the scan
    return snapshot_as_of(log.filter(F.col("arrival_time") <= cutoff), key=key)
