"""Exact microsecond arithmetic on timestamps without a zone.

Every operator computes on BIGINT microseconds since the epoch.  The conversions read the calendar fields of the
timestamp, so the session time zone (and its daylight-saving gaps) cannot change a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
EPOCH = datetime(1970, 1, 1)


def to_micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY
        + F.hour(ts).cast("bigint") * HOUR
        + F.minute(ts).cast("bigint") * (60 * SECOND)
        + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("bigint")
    )


def to_timestamp(micros: Column | str) -> Column:
    micros = F.col(micros) if isinstance(micros, str) else micros
    return F.timestamp_add("MICROSECOND", micros, ntz(EPOCH))


def ntz(value: datetime | str) -> Column:
    """A timestamp literal without a zone; folded to a constant, so filters on it reach the scan."""
    return F.lit(str(value)).cast("timestamp_ntz")


def micros_of(value: datetime | str) -> int:
    value = datetime.fromisoformat(value) if isinstance(value, str) else value
    return (value - EPOCH) // timedelta(microseconds=1)


def datetime_of(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


def hours(value: float) -> int:
    """Hours, possibly fractional, as whole microseconds."""
    return round(float(value) * HOUR)


def floor_div(a: Column, b: int | Column) -> Column:
    """Integer division that rounds down for negative values too."""
    a = a.cast("bigint")
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: int | Column) -> Column:
    return -floor_div(-a, b)


@dataclass(frozen=True)
class Grid:
    """The points start, start + step, ... that do not pass end, all in microseconds."""

    start: int
    step: int
    end: int

    @property
    def last_index(self) -> int:
        return (self.end - self.start) // self.step

    @property
    def size(self) -> int:
        return self.last_index + 1

    def index_at_or_after(self, micros: Column) -> Column:
        return ceil_div(micros - F.lit(self.start), self.step)

    def index_at_or_before(self, micros: Column) -> Column:
        return floor_div(micros - F.lit(self.start), self.step)

    def point(self, index: Column) -> Column:
        return F.lit(self.start) + index * F.lit(self.step)

    def at_or_after(self, micros: Column) -> Column:
        """First grid point at or after a time; null when the grid ends before it."""
        index = self.index_at_or_after(micros)
        return F.when(index <= self.last_index, self.point(index))

