"""Stored states of a log, so that a state as of a time needs the newest of them and the tail of the log only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..functions.clock import datetime_of, micros_of
from ..functions.measures import is_live
from ..operators.views import KEY, latest_rows
from .changelog import LOG_SCHEMA, read_log


def snapshot_times(spark: SparkSession, root: str) -> list[datetime]:
    """The times of the stored states, from the folder names; one that was not written whole is no state."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    times = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("as_of=") and files.exists(done):
            times.append(datetime_of(int(name.removeprefix("as_of="))))
    return sorted(times)


def state_as_of(spark: SparkSession, log_path: str, root: str, at: datetime | str, key: str = KEY) -> DataFrame:
    """State as of a time, from the newest stored state at or before it and the arrivals since.

    Which state that is is known when the plan is made, so the log is pruned to the dates of the tail.  A log only
    grows at its end: what arrived before a stored state must have been in the log when it was stored.
    """
    at = datetime_of(micros_of(at))
    before = [t for t in snapshot_times(spark, root) if t <= at]
    if not before:
        return latest_rows(read_log(spark, log_path, until=at), key=key).filter(is_live())
    stored = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/as_of={micros_of(before[-1])}")
    tail = read_log(spark, log_path, after=before[-1], until=at)
    return latest_rows(stored.unionByName(tail), key=key).filter(is_live())


def store_state(spark: SparkSession, log_path: str, root: str, at: datetime | str, key: str = KEY) -> None:
    """Store the state as of a time, worked out from the stored states before it; a repeat overwrites it.

    Deleted keys are not stored: only a later change could bring one back, and that is in the tail.
    """
    state_as_of(spark, log_path, root, at, key).write.mode("overwrite").parquet(f"{root}/as_of={micros_of(at)}")
