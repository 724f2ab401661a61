"""Sinks, and the JSON form of parameter columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.clock import to_micros
from .changelog import Profile, profile


def save_log(log: DataFrame, path: str, mode: str = "overwrite") -> Profile:
    """Store a log by arrival date and, within a date, by arrival; "append" adds a batch.

    The range split keeps files even when one date holds most rows, and gives every file a narrow span of arrivals.
    Size and bounds of what is written are observed on the way: a replay over it needs no pass of its own for them.
    The densest hour, which no observation can tell, comes from the stored arrivals, older batches included.
    """
    order = ["arrival_date", "arrival_time", "event_id"]
    dated = log.withColumn("arrival_date", F.col("arrival_time").cast("date"))
    sliced = dated.repartitionByRange(*order).sortWithinPartitions(*order)
    bounds, times = Observation(), [c for c in ("arrival_time", "event_time") if c in log.columns]
    micros = [to_micros(f(c)).alias(f"{f.__name__}_{c}") for c in times for f in (F.min, F.max)]
    observed = sliced.observe(bounds, F.count(F.lit(1)).alias("rows"), *micros)
    observed.write.mode(mode).partitionBy("arrival_date").parquet(path)
    found = bounds.get
    ends = [found.get(f"{f}_{c}") for c in ("arrival_time", "event_time") for f in ("min", "max")]
    stored = log.sparkSession.read.schema(log.select("arrival_time").schema).parquet(path)
    return Profile(found["rows"], *ends, densest_hour=profile(stored).densest_hour)


def save_results(
    root: str, timelines: DataFrame, outcomes: DataFrame, row_loads: DataFrame, run_type: str = "scenarios"
) -> None:
    """The three result tables of a study as sorted CSV, each marked with the kind of run.

    They repeat the labels of a run on every row of it, so the files are packed by gzip; ``read_csv`` reads them as any other.
    """
    for name, table, order in (
        ("snapshots", timelines, ("scenario", "policy", "metric", "arrival_time")),
        ("outcomes", outcomes, ("scenario", "policy")),
        ("row_loads", row_loads, ("scenario", "policy", "source_row_number", "event_id")),
    ):
        known = [c for c in order if c in table.columns]
        save_csv(table.withColumn("run_type", F.lit(run_type)), f"{root}/{name}", order=known, compression="gzip")


# Spark's default CSV format stops at milliseconds.
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def save_csv(df: DataFrame, path: str, order: Sequence[str] = (), compression: str = "none") -> None:
    """CSV with a header and full microseconds; ``order`` sorts by range across files, without a single writer."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").options(**CSV_OPTIONS).csv(path, compression=compression)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def params_to_json(params: Column | str) -> Column:
    """A map of parameters as JSON text with its keys in sorted order."""
    params = F.col(params) if isinstance(params, str) else params
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def params_from_json(text: Column | str) -> Column:
    return F.from_json(text, "map<string,double>")
