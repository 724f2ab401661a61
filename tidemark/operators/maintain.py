"""Table maintenance as DataFrame rewrites: upserts, merges, backfills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import ntz
from ..functions.measures import is_live
from .views import KEY, arrived_between, increment, latest_rows, snapshot_as_of


def delete_keys(target: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def rows_of_keys(log: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    return log.join(keys.select(key), key, "left_semi").select(*log.columns)


def upsert(target: DataFrame, latest: DataFrame, key: str = KEY) -> DataFrame:
    """Replace each key by its newest change; a tombstone removes the key."""
    return delete_keys(target, latest, key).unionByName(latest.filter(is_live()).select(*target.columns))


def full_refresh(log: DataFrame, cutoff: datetime | str) -> DataFrame:
    """Delete everything, insert the snapshot."""
    return snapshot_as_of(log, cutoff)


def incremental_merge(
    target: DataFrame, log: DataFrame, last: datetime | str | None, cutoff: datetime | str, key: str = KEY
) -> DataFrame:
    """Bring a state from ``last`` to ``cutoff``, touching only keys that changed in between.

    The newest change of such a key lies in the increment itself, so older parts of the log are not read.
    """
    return upsert(target, latest_rows(increment(log, last, cutoff), key=key), key)


def backfill_partition(
    target: DataFrame, log: DataFrame, start: datetime | str, end: datetime | str, key: str = KEY
) -> DataFrame:
    """Recompute the keys that changed in the closed arrival range [start, end] from that range alone."""
    return upsert(target, latest_rows(arrived_between(log, start, end), key=key), key)


def append_log(log: DataFrame, batch: DataFrame) -> DataFrame:
    return log.unionByName(batch.select(*log.columns))


def mark_final(windowed: DataFrame, watermark: datetime | str) -> DataFrame:
    """Set is_final for windows the watermark has passed; a window once final stays so."""
    return windowed.withColumn(
        "is_final", F.coalesce("is_final", F.lit(False)) | (F.col("window_end") <= ntz(watermark))
    )
