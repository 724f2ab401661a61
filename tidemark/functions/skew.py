"""Separating the few groups that are too large for one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

HOT_ROWS = 1_000_000
MAX_HOT_GROUPS = 50_000


def hot_limit(rows: int, hot_rows: int = HOT_ROWS) -> int:
    """Rows above which a group counts as hot.

    It grows with the input, so that no more than MAX_HOT_GROUPS groups can pass it: that bound is what makes the
    list of hot groups safe to broadcast at any scale.  A group just below it still sorts in one task: at 10**12 rows
    that is 20 million of them.
    """
    return max(int(hot_rows), math.ceil(rows / MAX_HOT_GROUPS))


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of hot groups, as a stored list of MAX_HOT_GROUPS rows at most; None when no group can be hot.

    ``rows`` is an upper bound of the row count of ``df``, of which only the keys are read.
    """
    limit = hot_limit(rows, hot_rows)
    if rows <= limit:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return materialize(counts.select(*keys), "hot-groups")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return condition


def with_hot_flag(df: DataFrame, keys: Sequence[str], groups: DataFrame, flag: str = "_hot") -> DataFrame:
    """Add a boolean column: does the row belong to a hot group?  The null group may be hot like any other."""
    listed = groups.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias(flag))
    flagged = df.join(F.broadcast(listed), same_keys(df, listed, keys, "_hot_"), "left")
    return flagged.drop(*[f"_hot_{k}" for k in keys]).withColumn(flag, F.coalesce(flag, F.lit(False)))


def split_hot(
    df: DataFrame, keys: Sequence[str], rows: int, hot_rows: int = HOT_ROWS, groups: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None when no group can be hot).

    ``rows`` is an upper bound of the row count of ``df``; ``groups`` its hot groups, if they are known already.
    """
    keys = list(keys)
    groups = hot_groups(df, keys, rows, hot_rows) if groups is None else groups
    if groups is None:
        return df, None
    flagged = with_hot_flag(df, keys, groups)
    return flagged.filter(~F.col("_hot")).drop("_hot"), flagged.filter("_hot").drop("_hot")


def with_group_minimum(
    df: DataFrame, keys: Sequence[str], source: str, name: str, rows: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the minimum of ``source`` within each group.

    Hot groups get it by a map-side aggregate and a broadcast of one row for each; their rows are spread over the
    window's partitions meanwhile.
    """
    keys = list(keys)
    limit = hot_limit(rows, hot_rows)
    within = F.min(source)
    if rows <= limit:
        return df.withColumn(name, within.over(Window.partitionBy(*keys)))
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(source).alias("_least"))
    found = found.filter(F.col("_n") > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_n", "_least")
    rows_ = df.join(F.broadcast(found), same_keys(df, found, keys, "_hot_"), "left")  # MAX_HOT_GROUPS rows at most
    spread = F.when(F.col("_n").isNotNull(), F.xxhash64(source)).otherwise(F.lit(0).cast("bigint"))
    rows_ = rows_.withColumn("_spread", spread)
    least = F.coalesce("_least", within.over(Window.partitionBy(*keys, "_spread")))
    return rows_.withColumn(name, least).select(*df.columns, name)
