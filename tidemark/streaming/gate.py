"""The window gate as a stream, exact to the row.

Spark's own watermark moves between micro-batches.  The gate's moves with every arrival: a row counts while its window
ends after the newest event time of all rows that arrived so far, its own arrival included, minus the lateness.  Within
a batch that newest event time is a running maximum over the arrivals; from one batch to the next only the maximum is
carried.  The last arrival of a batch may go on in the next one, so its rows are held back until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import hours, to_micros
from ..functions.ladder import running, time_widths
from ..operators.policies import WindowGate
from ..operators.views import KEY, observed_log
from ..sources.changelog import EVENT_COLUMNS, profile
from .jobs import LOG_DDL, read_batches, start_batches, write_batch

CARRY_DDL = "newest_us bigint"


def _carried(spark: SparkSession, root: str, batch_id: int) -> tuple[int | None, DataFrame]:
    """(newest event time, rows held back) after a batch; each batch reads those of the one before only."""
    if batch_id < 0:
        return None, spark.createDataFrame([], LOG_DDL)
    newest = spark.read.schema(CARRY_DDL).parquet(f"{root}/carry/batch_id={batch_id}").first()[0]  # one number
    return newest, spark.read.schema(LOG_DDL).parquet(f"{root}/held/batch_id={batch_id}")


def _judged(rows: DataFrame, newest: int | None, gate: WindowGate, count: int) -> DataFrame:
    """The rows that the gate accepts, given the newest event time of all earlier arrivals.

    The running maximum has one row for each arrival; it is joined back, as every row of an arrival is judged by the
    whole of it.
    """
    if gate.lateness < 0:
        return rows
    arrival, event = to_micros("arrival_time"), to_micros("event_time")
    reached = running(rows, arrival, {"_newest": ("max", event)}, widths=time_widths(count))
    carried = F.lit(newest).cast("bigint")
    reached = reached.select(F.col("position").alias("_arrival"), F.greatest("_newest", carried).alias("_newest"))
    rows = rows.withColumn("_event", event).withColumn("_at", arrival)
    rows = rows.join(reached, F.col("_at") == F.col("_arrival"))
    end = (gate.window_index(F.col("_event")) + 1) * hours(gate.size)
    # Without an event time there is no window: such a row counts only while there is no watermark.
    open_still = F.col("_newest").isNull() | F.coalesce(end > F.col("_newest") - hours(gate.lateness), F.lit(False))
    return rows.filter(open_still).select(*EVENT_COLUMNS)


def start_gate(
    stream: DataFrame, root: str, checkpoint: str, size: float, lateness: float, key: str = KEY
) -> StreamingQuery:
    """Write the rows that the window gate accepts, one folder for each micro-batch.

    Files must land in order of arrival, but an arrival may be torn apart by a cut: of the rows of a key that share
    one, the one with the highest event_id counts, and all of them see the same newest event time.  A batch that is
    processed again overwrites its own folders.
    """
    gate = WindowGate(size, lateness)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, held = _carried(spark, root, batch_id - 1)
        rows = held.unionByName(batch.select(*EVENT_COLUMNS)).filter(F.col("arrival_time").isNotNull())
        write_batch(observed_log(rows, key), f"{root}/observed", batch_id)
        rows = spark.read.schema(LOG_DDL).parquet(f"{root}/observed/batch_id={batch_id}")
        bounds = profile(rows)
        last: Column = to_micros("arrival_time") == F.lit(bounds.last_arrival)
        ready = rows.filter(~last)
        write_batch(_judged(ready, newest, gate, bounds.rows), f"{root}/accepted", batch_id)
        write_batch(rows.filter(last), f"{root}/held", batch_id)
        top = ready.agg(F.max(to_micros("event_time")).alias("top"))
        carry = top.select(F.greatest("top", F.lit(newest).cast("bigint")).alias("newest_us"))
        write_batch(carry, f"{root}/carry", batch_id)

    return start_batches(stream, each, checkpoint)


def read_gate(spark: SparkSession, root: str, size: float, lateness: float) -> DataFrame:
    """All accepted rows, those of the last arrival included: as if nothing more came."""
    accepted = read_batches(spark, f"{root}/accepted", LOG_DDL).select(*EVENT_COLUMNS)
    last = read_batches(spark, f"{root}/carry", CARRY_DDL).agg(F.max("batch_id")).first()[0]  # one number
    if last is None:
        return accepted
    newest, held = _carried(spark, root, last)
    return accepted.unionByName(_judged(held, newest, WindowGate(size, lateness), 1))
