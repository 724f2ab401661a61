"""Structured Streaming forms of the serving policies.

Each job is meant to run as ``availableNow`` steps (or a continuous trigger) over files that land in arrival order: a
micro-batch holds every change that arrived after the batch before it.  Sinks are append-only tables with one
``batch_id`` folder per micro-batch; a repeated batch overwrites its own folder, so a restart changes nothing.
Readers merge: the newest change per key wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import Grid, datetime_of, hours, to_micros, to_timestamp
from ..functions.measures import as_total, is_live, sales_amount
from ..operators.commits import commit_chain
from ..operators.policies import MIN_CADENCE_HOURS
from ..operators.views import KEY, committed_snapshot, increment, latest_rows, observed_log
from ..sources.changelog import EVENT_COLUMNS, LOG_SCHEMA, profile


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a landing folder, oldest first."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _log_batch(batch: DataFrame, root: str, batch_id: int, key: str) -> DataFrame:
    """Store the observed rows of a batch and read them back, so that the source is read once for each batch."""
    write_batch(observed_log(batch, key), f"{root}/log", batch_id)
    return batch.sparkSession.read.schema(LOG_DDL).parquet(f"{root}/log/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches of a sink, or those before one; empty when nothing was written yet."""
    full = f"{schema}, batch_id bigint"
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], full)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


LOG_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields)


# -- latest state --------------------------------------------------------------------------------------------


def start_latest_state(stream: DataFrame, table: str, checkpoint: str, key: str = KEY) -> StreamingQuery:
    """Keep the newest change per key; a batch writes one row per key it touches, tombstones included."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_rows(batch, key=key), table, batch_id)

    return start_batches(stream, each, checkpoint)


def read_latest_state(spark: SparkSession, table: str, key: str = KEY) -> DataFrame:
    newest = latest_rows(read_batches(spark, table, LOG_DDL).select(*EVENT_COLUMNS), key=key)
    return newest.filter(is_live())


# -- lagged reconcile ----------------------------------------------------------------------------------------

_FIRED_DDL = "cell bigint, fired_us bigint, cutoff_us bigint"


def start_reconcile(
    stream: DataFrame, root: str, checkpoint: str, every: float, lag: float, key: str = KEY
) -> StreamingQuery:
    """Log each batch; when a cadence cell sees its first arrival, merge the changes up to that time minus the lag.

    Several reconciles within one batch leave the same state as the last of them, so only that one is merged; all of
    them are recorded.
    """
    step, late = hours(max(MIN_CADENCE_HOURS, every)), hours(max(0.0, lag))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = _log_batch(batch, root, batch_id, key)
        bounds = profile(batch)
        if bounds.empty:
            return
        before = read_batches(spark, f"{root}/fired", _FIRED_DDL, before=batch_id)
        first, last_cell, last_cutoff = before.agg(
            F.min("fired_us"), F.max("cell"), F.max("cutoff_us")
        ).first()  # one row
        grid = Grid(bounds.first_arrival if first is None else first, step, bounds.last_arrival)
        arrival = to_micros("arrival_time")
        fired = (
            batch.groupBy(grid.index_at_or_before(arrival).alias("cell"))
            .agg(F.min(arrival).alias("fired_us"))
            .filter(F.col("cell") > (-1 if last_cell is None else last_cell))
            .withColumn("cutoff_us", F.col("fired_us") - late)
        )
        write_batch(fired, f"{root}/fired", batch_id)
        cutoff = spark.read.schema(_FIRED_DDL).parquet(f"{root}/fired/batch_id={batch_id}").agg(F.max("cutoff_us"))
        cutoff = cutoff.first()[0]
        if cutoff is None:
            return
        log = read_batches(spark, f"{root}/log", LOG_DDL).select(*EVENT_COLUMNS)
        news = increment(log, None if last_cutoff is None else datetime_of(last_cutoff), datetime_of(cutoff))
        write_batch(latest_rows(news, key=key), f"{root}/served", batch_id)

    return start_batches(stream, each, checkpoint)


def read_reconciled(spark: SparkSession, root: str, key: str = KEY) -> DataFrame:
    return read_latest_state(spark, f"{root}/served", key)


def read_reconciles(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, f"{root}/fired", _FIRED_DDL)


# -- commit snapshots ----------------------------------------------------------------------------------------

_COMMIT_DDL = "commit_us bigint, commit_cutoff timestamp_ntz"


def start_commits(stream: DataFrame, root: str, checkpoint: str, every: float, key: str = KEY) -> StreamingQuery:
    """Log each batch and add the commits that fall due in it, chained to the last commit of the batches before."""
    step = hours(max(0.0, every))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = _log_batch(batch, root, batch_id, key)
        last_commit = (
            read_batches(spark, f"{root}/commits", _COMMIT_DDL, before=batch_id).agg(F.max("commit_us")).first()[0]
        )
        due = batch
        if last_commit is not None:
            due = batch.filter(to_micros("arrival_time") >= max(last_commit + step, last_commit + 1))
        bounds = profile(due)
        commits = commit_chain(due, step, bounds.first_arrival, bounds.last_arrival, bounds.rows)
        write_batch(commits.select("commit_us", to_timestamp("commit_us").alias("commit_cutoff")), f"{root}/commits", batch_id)

    return start_batches(stream, each, checkpoint)


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, f"{root}/commits", _COMMIT_DDL)


def read_committed(spark: SparkSession, root: str, key: str = KEY) -> DataFrame:
    """State as of the newest commit, whatever was logged after it."""
    log = read_batches(spark, f"{root}/log", LOG_DDL).select(*EVENT_COLUMNS)
    return committed_snapshot(log, read_commits(spark, root), key)


# -- event-time windows --------------------------------------------------------------------------------------


def windowed_sales(stream: DataFrame, size: str, lateness: str) -> DataFrame:
    """Sales of live changes per tumbling event-time window, with a watermark.

    Spark moves the watermark between micro-batches, so a row is dropped by the watermark of the batches before it;
    the exact row-level rule is the window gate.  In append mode a window comes out once, when it is final.
    """
    # A watermark needs an instant: the zone-less event time is read as UTC and turned back at the end.
    return (
        stream.withColumn("event_instant", F.timestamp_micros(to_micros("event_time")))
        .withWatermark("event_instant", lateness)
        .groupBy(F.window("event_instant", size))
        .agg(
            F.sum(F.when(is_live(), sales_amount())).alias("total_sales"),
            F.count_if(is_live()).alias("active_row_count"),
        )
        .select(
            to_timestamp(F.unix_micros("window.start")).alias("window_start"),
            to_timestamp(F.unix_micros("window.end")).alias("window_end"),
            as_total(F.col("total_sales")).alias("total_sales"),
            "active_row_count",
        )
    )


_WINDOW_DDL = "window_start timestamp_ntz, window_end timestamp_ntz, total_sales double, active_row_count bigint"


def start_windowed_sales(
    stream: DataFrame, table: str, checkpoint: str, size: str, lateness: str
) -> StreamingQuery:
    return start_batches(
        windowed_sales(stream, size, lateness), lambda batch, i: write_batch(batch, table, i), checkpoint
    )


def read_windowed_sales(spark: SparkSession, table: str) -> DataFrame:
    return read_batches(spark, table, _WINDOW_DDL)
