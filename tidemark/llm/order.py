"""Positions and running sums along one global order, from totals of its parts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize
from .text import fresh, with_column


SLOT = 1 << 16  # rows whose sizes one task sums up in order


def in_order(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, str]:
    """(rows with a new column, its name): the row's position along the order, from 0.

    The rows are range-partitioned and sorted once; a tie-breaker splits even a key that most rows share.  The ids that
    Spark gives to sorted rows hold partition and place, so the rows are written once to the shared folder without
    passing through Python, and the partitions' counts (one row for each partition) give what comes before each.
    """
    tie, part, row, before = fresh(df, "_tie", "_part", "_row", "_before")
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, F.col(tie).asc()]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    at = F.col(row)
    placed = placed.withColumn(row, F.monotonically_increasing_id())
    placed = placed.withColumns({part: F.shiftright(at, 33), row: at.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialize(placed, "ordered")

    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    counts = counts.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    rows = rows.join(F.broadcast(counts), part)  # one row for each partition
    return rows.withColumn(row, F.col(row) + F.col(before)).drop(part, before), row


def sums_before(rows: DataFrame, row: str, value: str) -> DataFrame:
    """row, value (null: 0) and ``before``, the sum of the values of all earlier rows; only these columns travel.

    Runs of consecutive positions are summed up each for itself, and their totals (one row for each run) give what comes
    before each.
    """
    narrow = rows.select(row, F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias(value), F.floor(F.col(row) / SLOT).alias("slot"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = narrow.groupBy("slot").agg(F.sum(value).alias("total"))
    totals = totals.select("slot", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("slot").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.withColumn("before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return sums.join(F.broadcast(totals), "slot").select(row, value, (F.col("start") + F.col("before")).alias("before"))


def in_groups(df: DataFrame, group: str, order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """(rows with new columns, their names): the number of the row's group, and the row's place within its group.

    Groups are numbered in ascending order of their values, null first, and both numbers begin at 0.  Rows are
    range-partitioned by group and ``order`` with a tie-breaker, so a group of any size is spread over as many
    partitions as it needs; what a group has in earlier partitions follows from one row for each partition.
    """
    tie, part, nth, at, number, place = fresh(df, "_tie", "_part", "_nth", "_at", "_group", "_place")
    keys = [F.col(group).asc_nulls_first(), *order]
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    keys.append(F.col(tie).asc())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, count, rows = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            values = batch.column(group)
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            goes_on = last is not None and values[0] == last
            numbers = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
            places = np.arange(len(codes)) - starts[numbers]
            if goes_on:
                places[numbers == 0] += rows
            count += 0 if goes_on else 1
            numbers = numbers + count
            count, rows, last = int(numbers[-1]), int(places[-1]) + 1, values[-1]
            added = {part: np.full(len(codes), here, np.int32), nth: numbers, at: places}
            for name, column in added.items():
                batch = with_column(batch, name, pa.array(column))
            yield batch

    fields = [T.StructField(part, T.IntegerType()), T.StructField(nth, T.LongType()), T.StructField(at, T.LongType())]
    rows = materialize(placed.mapInArrow(run, T.StructType([*placed.schema.fields, *fields])), "grouped")

    along = F.struct(nth, at)
    ends = rows.groupBy(F.col(part).alias("p")).agg(
        F.max(nth).alias("groups"),
        F.min_by(F.struct(F.col(group).alias("value")), along).alias("first"),
        F.max_by(F.struct(F.col(group).alias("value")), along).alias("last"),
        (F.max_by(at, along) + 1).alias("rows"),
    )
    by_part = Window.orderBy("p")  # one row for each partition
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("last").over(by_part)
    ends = ends.withColumn("goes_on", before.isNotNull() & F.col("first").eqNullSafe(before))
    through = F.col("goes_on") & (F.col("groups") == 0)
    ends = ends.withColumn("run", F.sum(F.when(through, 0).otherwise(1)).over(by_part))
    ends = ends.withColumn("tail", F.sum("rows").over(Window.partitionBy("run").orderBy("p")))
    ends = ends.select(
        F.col("p").alias(part),
        (F.coalesce(F.sum(F.col("groups") + F.when(F.col("goes_on"), 0).otherwise(1)).over(earlier), F.lit(0))
         - F.col("goes_on").cast("int")).alias(number),
        F.when(F.col("goes_on"), F.lag("tail").over(by_part)).otherwise(0).alias(place),
    )
    rows = rows.join(F.broadcast(ends), part)
    numbered = F.col(nth) + F.col(number)
    within = F.col(at) + F.when(F.col(nth) == 0, F.col(place)).otherwise(0)
    return rows.withColumns({number: numbered, place: within}).drop(part, nth, at), [number, place]
