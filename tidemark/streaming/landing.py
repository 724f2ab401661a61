"""Feeding a stored log to a stream in arrival order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import ntz
from ..sources.changelog import EVENT_COLUMNS


def replay_in_steps(
    log: DataFrame, cuts: Sequence[datetime | str], folder: str, start: Callable[[], StreamingQuery]
) -> None:
    """Land the log up to each cut (and then the rest) and let the job catch up after every step."""
    edges: list[datetime | str | None] = [None, *cuts, None]
    for lower, upper in zip(edges, edges[1:]):
        rows = log
        if lower is not None:
            rows = rows.filter(F.col("arrival_time") > ntz(lower))
        if upper is not None:
            rows = rows.filter(F.col("arrival_time") <= ntz(upper))
        land(rows, folder, start)


def land(rows: DataFrame, folder: str, start: Callable[[], StreamingQuery]) -> None:
    """Add rows to a landing folder and let the job catch up."""
    rows.select(*EVENT_COLUMNS).write.mode("append").parquet(folder)
    start().awaitTermination()
