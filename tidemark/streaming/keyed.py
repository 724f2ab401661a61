"""Streaming jobs whose result lives in the state store, one entry for each key.

Nothing is kept by batch: a micro-batch reads and writes the entries of the keys it touches, RocksDB holds the rest on
disk, and the state data source reads the entries as a table.  The aggregates run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import to_micros, to_timestamp
from ..functions.measures import is_live
from ..operators.views import KEY
from ..session import settings
from ..sources.changelog import EVENT_COLUMNS

# A query takes its state store from the session's settings when it starts for the first time.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
INSTANT = "arrival_instant"


def _newest(group: list[str], order: list[str], columns: list[str]) -> tuple[list[str], Column]:
    rest = [c for c in columns if c not in group]
    return rest, F.max_by(F.struct(*rest), F.struct(*order)).alias("row")


def _state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, row) of all entries: the row that an aggregate holds is the first field of its buffer."""
    state = spark.read.format("statestore").load(checkpoint)
    held = state.schema["value"].dataType.fieldNames()[0]
    return state.select("key", F.col("value")[held].alias("row"))


# -- latest state --------------------------------------------------------------------------------------------


def start_keyed_state(stream: DataFrame, checkpoint: str, key: str = KEY) -> StreamingQuery:
    """Keep the newest change of each key, tombstones included, as state; nothing else is written.

    A change that arrives out of order is compared with the entry like any other.  Changes without an arrival are
    left out.  A null key is a key.
    """
    _, newest = _newest([key], ["arrival_time", "event_id"], EVENT_COLUMNS)
    state = stream.filter(F.col("arrival_time").isNotNull()).groupBy(key).agg(newest)
    with settings(stream.sparkSession, STATE):
        return (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def read_keyed_state(spark: SparkSession, checkpoint: str, key: str = KEY) -> DataFrame:
    """The live rows of the state as the last micro-batch left it."""
    rows = _state_rows(spark, checkpoint)
    columns = [F.col("key")[key].alias(c) if c == key else F.col("row")[c].alias(c) for c in EVENT_COLUMNS]
    return rows.select(*columns).filter(is_live())


# -- one row for each key and arrival ------------------------------------------------------------------------


def start_dedup(stream: DataFrame, table: str, checkpoint: str, key: str = KEY, delay: str = "1 second") -> StreamingQuery:
    """Of the rows of a key that share an arrival, keep the one with the highest event_id, whatever batches they are in.

    A (key, arrival) waits in the state until a row has arrived more than ``delay`` later; then it is written, in a
    folder for its micro-batch.  ``delay`` is how far files may be out of order, a millisecond at least, since
    that is how fine a watermark is.  Rows that are later still are dropped, and counted by Spark
    (numRowsDroppedByWatermark in the query's progress).
    """
    instants = stream.filter(F.col("arrival_time").isNotNull()).withColumn(INSTANT, F.timestamp_micros(to_micros("arrival_time")))
    _, newest = _newest([key, "arrival_time"], ["event_id"], EVENT_COLUMNS)
    rows = instants.withWatermark(INSTANT, delay).groupBy(key, INSTANT).agg(newest)

    def each(batch: DataFrame, batch_id: int) -> None:
        _observed(batch, F.col(key), F.col(INSTANT), key).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    with settings(stream.sparkSession, STATE):
        return (
            rows.writeStream.outputMode("append").foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _observed(rows: DataFrame, key_column: Column, instant: Column, key: str) -> DataFrame:
    own = {key: key_column, "arrival_time": to_timestamp(F.unix_micros(instant))}
    return rows.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in EVENT_COLUMNS])


def read_dedup(spark: SparkSession, table: str, checkpoint: str, key: str = KEY) -> DataFrame:
    """The rows written so far and those that still wait in the state: the deduplicated log of all rows read."""
    from .jobs import LOG_DDL, read_batches

    written = read_batches(spark, table, LOG_DDL).select(*EVENT_COLUMNS)
    waiting = _state_rows(spark, checkpoint)
    return written.unionByName(_observed(waiting, F.col("key")[key], F.col("key")[INSTANT], key))
