"""Change logs: schema, scan, derivation from an event table, profile, ingest order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.clock import HOUR, Grid, datetime_of, floor_div, ntz, to_micros, to_timestamp
from ..functions.ladder import INDEX_WIDTHS, running
from ..functions.skew import HOT_ROWS, with_group_minimum
from ..operators.sequence import source_row_number

LOG_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("sale_id", T.LongType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("arrival_time", T.TimestampNTZType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("region_name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("is_update", T.BooleanType()),
        T.StructField("is_deleted", T.BooleanType()),
    ]
)
EVENT_COLUMNS = LOG_SCHEMA.fieldNames()


def check_log(log: DataFrame) -> DataFrame:
    """Reject a frame that lacks a log column or has it in another type."""
    types = {f.name: f.dataType for f in log.schema.fields}
    for field in LOG_SCHEMA.fields:
        if types.get(field.name) != field.dataType:
            raise ValueError(
                f"change log column {field.name}: expected {field.dataType.simpleString()}, "
                f"got {types[field.name].simpleString() if field.name in types else 'nothing'}"
            )
    return log


def read_log(
    spark: SparkSession, path: str, after: datetime | str | None = None, until: datetime | str | None = None
) -> DataFrame:
    """Scan a stored log, all of it or the arrivals in (after, until].

    The bounds prune folders by arrival date and reach the row groups by arrival time.
    """
    stored = T.StructType([*LOG_SCHEMA.fields, T.StructField("arrival_date", T.DateType())])
    log = spark.read.schema(stored).parquet(path)
    if after is not None:
        log = log.filter((F.col("arrival_date") >= ntz(after).cast("date")) & (F.col("arrival_time") > ntz(after)))
    if until is not None:
        log = log.filter((F.col("arrival_date") <= ntz(until).cast("date")) & (F.col("arrival_time") <= ntz(until)))
    return log.select(*EVENT_COLUMNS)


def changelog(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = EVENT_COLUMNS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The ``events`` table as a change log of inserts, updates, deletes and late arrivals.

    Only the asked-for columns are derived; without ``event_time`` (the first time an entity is seen) no shuffle
    is needed.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event_id, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    lag = ((event_id * 7919) % 86400) * 1_000_000 + F.when(
        event_id % 5 == 0, (event_id % 9 + 1) * 86_400_000_000
    ).otherwise(F.lit(0).cast("bigint"))
    derived = {
        "event_id": event_id,
        "sale_id": user * 100 + k,
        "arrival_time": F.timestamp_add("MICROSECOND", lag, F.col("ts")),
        "product_name": F.concat(F.lit("Product_"), (event_id % 10 + 1).cast("string")),
        "category": F.when(event_id % 4 == 0, "Electronics")
        .when(event_id % 4 == 1, "Clothing")
        .when(event_id % 4 == 2, "Books")
        .otherwise("Food"),
        "region_name": F.concat(F.lit("Region_"), (user % 10 + 1).cast("string")),
        "country": F.when(user % 3 == 0, "USA").when(user % 3 == 1, "EU").otherwise("APAC"),
        "quantity": (F.lit(1) + k % 24).cast("int"),
        "amount": F.col("value"),
        "is_update": F.col("event_type").isin("click", "view"),
        "is_deleted": F.col("event_type") == "error",
    }
    wanted = [c for c in columns if c != "event_time"]
    if "event_time" not in columns:
        return events.select(*[derived[c].alias(c) for c in wanted])
    keep = set(wanted) | {"sale_id"}
    log = events.select(*[derived[c].alias(c) for c in derived if c in keep], "ts")
    log = with_group_minimum(log, ["sale_id"], "ts", "event_time", events.count(), hot_rows)
    return log.select(*columns)


@dataclass(frozen=True)
class Profile:
    """Size and time bounds of a log, in microseconds; None for an empty log or bounds that were not asked for.

    ``densest_hour``: the most rows that arrive in one hour; None where it is not known.
    """

    rows: int
    first_arrival: int | None = None
    last_arrival: int | None = None
    first_event: int | None = None
    last_event: int | None = None
    densest_hour: int | None = None

    @property
    def empty(self) -> bool:
        return self.first_arrival is None

    def grid(self, step: int) -> Grid:
        """Regular points from the first arrival on; no point for an empty log."""
        return Grid(0, step, -1) if self.empty else Grid(self.first_arrival, step, self.last_arrival)

    @property
    def last_arrival_time(self) -> datetime | None:
        return None if self.last_arrival is None else datetime_of(self.last_arrival)


def profile(log: DataFrame, event_bounds: bool = False) -> Profile:
    """One aggregate job that brings a single row to the driver; the bounds become literals of later plans."""
    wanted = ["arrival_time"] + (["event_time"] if event_bounds else [])
    bounds = {f"{f.__name__}_{c}": (f, c) for c in wanted for f in (F.min, F.max)}
    hourly = log.groupBy(floor_div(to_micros("arrival_time"), HOUR).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(n) for n, (f, c) in bounds.items()]
    )
    densest = F.coalesce(F.max(F.when(F.col("hour").isNotNull(), F.col("n"))), F.lit(0))
    row = hourly.agg(F.coalesce(F.sum("n"), F.lit(0)), *[to_micros(f(n)) for n, (f, _) in bounds.items()], densest).first()
    return Profile(*row[:-1], densest_hour=row[-1])


def source_profile(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.min("event_time").alias("min_event_time"),
        F.max("event_time").alias("max_event_time"),
    )


def arrival_bounds(log: DataFrame) -> DataFrame:
    return log.agg(
        F.min("arrival_time").alias("min_arrival_time"), F.max("arrival_time").alias("max_arrival_time")
    )


def unique_arrivals(log: DataFrame, rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Make arrivals strictly increasing in (arrival_time, event_id) order, moving ties on by a microsecond each.

    Rows without an arrival keep none.  The i-th arrival becomes max(t_j - j for j <= i) + i, so the step-by-step bump is one running maximum.
    """
    rows = log.count() if rows is None else rows
    numbered = source_row_number(log, rows, hot_rows).select("event_id", "arrival_us", "source_row_number")
    number = F.col("source_row_number")
    bumped = running(
        numbered,
        number,
        {"lead": ("max", F.col("arrival_us") - number)},
        at={"event_id": F.max("event_id")},
        widths=INDEX_WIDTHS,
    ).select("event_id", to_timestamp(F.col("lead") + F.col("position")).alias("arrival_time"))
    return log.drop("arrival_time").join(bumped, "event_id", "left").select(*log.columns)


def register(log: DataFrame, name: str) -> DataFrame:
    """Expose a log as a named relation for ``spark.sql``."""
    log.createOrReplaceTempView(name)
    return log

