"""A stored timeline that is kept up to date: an appended batch adds differences to the slots it touches.

A row of the log moves the served value at its arrival and, in the other direction, when a newer change of its key
arrives.  A batch may come late and fall between rows that are there already; then the moves of its keys change, and
only their differences are stored, by day, next to the totals of each day.  Both add up, so nothing is rewritten: the
value at a time is the totals of the days before it and a running sum within its day.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import to_micros, to_timestamp
from ..functions.ladder import running, time_widths
from ..functions.measures import as_total, is_live, sales_amount
from ..functions.skew import HOT_ROWS
from ..session import materialize
from .policies import Immediate
from .replay import Replay
from .views import KEY

BUCKETS = 64
_MOVES = "position bigint, value decimal(38,4), seen bigint, batch bigint, day date"
_TOTALS = "day date, value decimal(38,4), seen bigint, batch bigint"


class KeptTimeline:
    """Total of a measure over the live rows at every arrival, as the immediate policy serves it, kept in a folder.

    ``history`` holds the rows seen so far (key, arrival, number, amount) in buckets by key, ``moves`` the differences
    by day, ``totals`` their sums per day.  Each append writes a folder of its own in all three; one that is repeated
    with the same batch number overwrites them, and reads only what batches before it have written.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = KEY, buckets: int = BUCKETS, hot_rows: int = HOT_ROWS):
        self.spark, self.root, self.key, self.buckets, self.hot_rows = spark, root, key, buckets, hot_rows

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _moves(self, rows: DataFrame, sign: int) -> DataFrame:
        """(position, value): what each row of whole keys adds at its arrival and takes away when it is superseded."""
        spans = Replay(rows, [Immediate()], key=self.key, measures={"m": F.col("m")}, hot_rows=self.hot_rows)
        spans = spans.per_policy("measure_0").filter("visible IS NOT NULL")
        ends = F.array(
            F.struct(F.col("visible").alias("position"), (F.col("measure_0") * sign).alias("value")),
            F.struct(F.col("superseded").alias("position"), (F.col("measure_0") * -sign).alias("value")),
        )
        return spans.select(F.explode(ends).alias("_e")).select("_e.*").filter("position IS NOT NULL")

    def append(self, batch: DataFrame, number: int, measure: Column | None = None) -> list[date]:
        """Add log rows; returns the days whose values moves fall on.

        Of what is stored only the buckets of the batch's keys are read, and only their keys' rows are worked on.
        """
        measure = sales_amount() if measure is None else measure
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        news = batch.filter(F.col("arrival_time").isNotNull()).select(
            self.key, "event_id", "arrival_time", (~is_live()).alias("is_deleted"), measure.cast("decimal(38,4)").alias("m")
        )
        news = materialize(news.withColumn("bucket", bucket), "news")
        touched = [r[0] for r in news.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        kind = news.schema[self.key].dataType.simpleString()
        schema = f"{self.key} {kind}, event_id bigint, arrival_time timestamp_ntz, is_deleted boolean, m decimal(38,4), batch bigint, bucket int"
        old = self._stored("history", schema).filter((F.col("batch") < number) & F.col("bucket").isin(touched))
        keys = news.select(F.col(self.key).alias("_key")).distinct()
        old = materialize(old.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi").select(*news.columns), "old")

        moves = self._moves(old.unionByName(news), 1).unionByName(self._moves(old, -1)).withColumn("seen", F.lit(0).cast("bigint"))
        arrivals = news.select(
            to_micros("arrival_time").alias("position"), F.lit(0).cast("decimal(38,4)").alias("value"), F.lit(1).cast("bigint").alias("seen")
        )
        changed = moves.select("position", F.col("value").cast("decimal(38,4)").alias("value"), "seen").unionByName(arrivals)
        changed = changed.groupBy("position").agg(F.sum("value").cast("decimal(38,4)").alias("value"), F.sum("seen").alias("seen"))
        changed = changed.filter("value <> 0 OR seen > 0").withColumn("day", to_timestamp("position").cast("date"))
        path = f"batch={number}"
        # Dealt by range, a folder has few files, and one with most of the rows has several.
        changed.repartitionByRange("day", "position").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/moves/{path}")
        own = self.spark.read.schema(_MOVES).option("basePath", f"{self.root}/moves").parquet(f"{self.root}/moves/{path}")
        totals = own.groupBy("day").agg(F.sum("value").cast("decimal(38,4)").alias("value"), F.sum("seen").alias("seen"))
        totals.write.mode("overwrite").parquet(f"{self.root}/totals/{path}")
        news.repartitionByRange("bucket", "arrival_time").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/history/{path}")
        return sorted(r[0] for r in totals.select("day").collect())  # one for each day

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """arrival_time, event_count, value at every arrival of some days (default: all); other days are not read."""
        moves, totals = self._stored("moves", _MOVES), self._stored("totals", _TOTALS)
        before = None
        if first is not None:
            before = totals.filter(F.col("day") < F.lit(first)).agg(F.sum("value"), F.sum("seen")).first()  # two numbers
            moves = moves.filter(F.col("day") >= F.lit(first))
        if last is not None:
            moves = moves.filter(F.col("day") <= F.lit(last))
        value, seen = (before[0] or 0, before[1] or 0) if before is not None else (0, 0)
        rows = totals.agg(F.sum("seen")).first()[0] or 0
        found = running(
            moves,
            F.col("position"),
            {"value": ("sum", F.col("value")), "event_count": ("sum", F.col("seen"))},
            at={"arrived": F.sum("seen")},
            widths=time_widths(3 * rows),
        )
        return found.filter("arrived > 0").select(
            to_timestamp("position").alias("arrival_time"),
            (F.col("event_count") + F.lit(seen)).alias("event_count"),
            as_total(F.col("value") + F.lit(value)).alias("value"),
        )
