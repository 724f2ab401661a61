"""Visibility policies: when does a change of the log become visible to readers?

Every policy comes down to one value per log row, the time at which the row becomes visible (null: never).  State,
value timeline and load counts follow from it in the same way for all of them (see ``replay``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import Grid, ceil_div, floor_div, hours, to_micros
from ..functions.ladder import INDEX_WIDTHS, running
from ..sources.changelog import Profile
from .commits import commit_chain
from .views import KEY

MIN_CADENCE_HOURS = 0.001
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Row:
    """The columns of one log row that a policy may read; times are microseconds."""

    arrival: Column = field(default_factory=lambda: F.col("arrival_us"))
    event: Column = field(default_factory=lambda: F.col("event_us"))
    next_arrival: Column = field(default_factory=lambda: F.col("next_arrival_us"))
    live: Column = field(default_factory=lambda: F.col("live"))


@dataclass(frozen=True)
class Cells:
    """(cell, here, after): the least value in a cell and the least one in a later cell."""

    table: DataFrame
    cell: Column
    count: int

    def attach(self, log: DataFrame, prefix: str) -> DataFrame:
        table = self.table.toDF(f"{prefix}_cell", f"{prefix}_here", f"{prefix}_after")
        if self.count <= BROADCAST_CELLS:
            table = F.broadcast(table)
        return log.join(table, self.cell == table[f"{prefix}_cell"], "left").drop(f"{prefix}_cell")


@dataclass(frozen=True)
class Prepared:
    """Lookup table joined to the log by a cell number, and (at_us, cutoff_us) marks.

    Without marks the cutoff at an observation point is the point itself.
    """

    cells: Cells | None = None
    marks: DataFrame | None = None


@dataclass(frozen=True)
class Policy:
    name: ClassVar[str] = ""
    observed: ClassVar[bool] = False  # reads one row per (key, arrival)
    needs_event_time: ClassVar[bool] = False
    cadence: ClassVar[str | None] = None  # the parameter that sets how often readers see news

    def params(self) -> dict[str, float]:
        return {f.name: float(getattr(self, f.name)) for f in fields(self)}

    def cadence_hours(self) -> float | None:
        return None if self.cadence is None else float(getattr(self, self.cadence))

    def grid(self, profile: Profile) -> Grid | None:
        """Regular observation points; None when the policy is observed at every arrival."""
        return None

    def prepare(self, log: DataFrame, profile: Profile, key: str = KEY) -> Prepared:
        """What the visibility rule has to look up in the log itself."""
        return Prepared()

    def visible(self, profile: Profile, row: Row, here: Column, after: Column) -> Column:
        raise NotImplementedError

    def loads(self, profile: Profile, row: Row, visible: Column, superseded: Column) -> Column:
        """How often the row is written."""
        raise NotImplementedError


def _cell_table(values: DataFrame, first_cell: int, count: int, cells: DataFrame | None = None) -> DataFrame:
    """(cell, here, after) from (cell, value): the least value of a cell and of all later cells.

    One row for each of ``count`` cells, or for those in ``cells`` only.
    """
    if cells is None:
        cells = values.sparkSession.range(first_cell, first_cell + count).select(F.col("id").alias("cell"))
    dense = cells.unionByName(values, allowMissingColumns=True)
    return running(
        dense,
        F.col("cell"),
        {"after": ("min", F.col("value"))},
        at={"here": F.min("value")},
        strict=True,
        reverse=True,
        widths=INDEX_WIDTHS,
        bound=count + 1,
    ).select(F.col("position").alias("cell"), "here", "after")


def _next_at_or_after(target: Column, here: Column, after: Column) -> Column:
    return F.when(here >= target, here).otherwise(after)


def _live_once_per_point(grid: Grid, row: Row) -> Column:
    """Grid points at which a row is the newest of its key: those in [arrival, next_arrival)."""
    return F.greatest(_points_before(grid, row.next_arrival) - grid.index_at_or_after(row.arrival), F.lit(0))


def _points_before(grid: Grid, end: Column) -> Column:
    """Number of grid points before a time; all of them for a null time."""
    return F.coalesce(F.least(grid.index_at_or_after(end), F.lit(grid.size)), F.lit(grid.size))


@dataclass(frozen=True)
class Immediate(Policy):
    """Each change is visible when it arrives: the ground truth."""

    name: ClassVar[str] = "immediate"

    def visible(self, profile, row, here, after):
        return row.arrival

    def loads(self, profile, row, visible, superseded):
        return F.lit(1)


@dataclass(frozen=True)
class FullRefresh(Policy):
    """The whole state is recomputed at every grid point; changes after the last point stay unseen."""

    every: float = 6.0

    name: ClassVar[str] = "full_refresh"
    cadence: ClassVar[str | None] = "every"

    def step(self) -> int:
        if self.every <= 0:
            raise ValueError("every must be > 0")
        return hours(self.every)

    def grid(self, profile):
        return profile.grid(self.step())

    def visible(self, profile, row, here, after):
        return self.grid(profile).at_or_after(row.arrival)

    def loads(self, profile, row, visible, superseded):
        return F.when(row.live, _live_once_per_point(self.grid(profile), row)).otherwise(F.lit(0))


@dataclass(frozen=True)
class PeriodicSnapshot(FullRefresh):
    """A semantic snapshot rebuilt at every grid point; very short cadences are raised to a minimum."""

    name: ClassVar[str] = "periodic_snapshot"

    def step(self) -> int:
        return hours(max(MIN_CADENCE_HOURS, self.every))


@dataclass(frozen=True)
class HotWindow(Policy):
    """Each refresh reads only the arrivals of the last ``hot`` hours; every ``full_every`` hours it reads all.

    A row that falls outside the hot window of its first refresh waits for the next full one, so visibility is not
    monotone in arrival.
    """

    hot: float = 720.0
    every: float = 1.0
    full_every: float = 336.0

    name: ClassVar[str] = "hot_window"
    cadence: ClassVar[str | None] = "every"

    def __post_init__(self):
        if self.every <= 0 or self.full_every <= 0:
            raise ValueError("every and full_every must be > 0")

    def grid(self, profile):
        return profile.grid(hours(self.every))

    def _full_points_up_to(self, index: Column) -> Column:
        """Full refreshes at grid points 1..index: multiples of full_every, each moved up to the grid."""
        every, full = hours(self.every), hours(self.full_every)
        if full <= every:
            return F.greatest(index, F.lit(0))
        return F.greatest(floor_div(index * F.lit(every), full), F.lit(0))

    def _full_point_from(self, index: Column) -> Column:
        """Index of the first full refresh at grid point ``index`` or later."""
        every, full = hours(self.every), hours(self.full_every)
        if full <= every:
            return F.greatest(index, F.lit(1))
        multiple = F.greatest(floor_div((index - 1) * F.lit(every), full) + 1, F.lit(1))
        return ceil_div(multiple * F.lit(full), every)

    def visible(self, profile, row, here, after):
        grid = self.grid(profile)
        index = grid.index_at_or_after(row.arrival)
        in_hot = row.arrival >= grid.point(index) - F.lit(hours(self.hot))
        index = F.when(in_hot, index).otherwise(self._full_point_from(index))
        return F.when(index <= grid.last_index, grid.point(index))

    def loads(self, profile, row, visible, superseded):
        grid = self.grid(profile)
        first = grid.index_at_or_after(row.arrival)
        end = _points_before(grid, row.next_arrival)
        hot_last = grid.index_at_or_before(row.arrival + F.lit(hours(self.hot)))
        hot_end = F.least(end, hot_last + 1)
        in_hot = F.greatest(hot_end - first, F.lit(0))
        # Later points load the row only when they are full ones.
        later = F.greatest(hot_last + 1, first)
        full = F.greatest(
            self._full_points_up_to(end - 1) - self._full_points_up_to(later - 1), F.lit(0)
        )
        return F.when(row.live, in_hot + full).otherwise(F.lit(0))


@dataclass(frozen=True)
class LaggedReconcile(Policy):
    """Changes are logged on arrival and merged into the state at most every ``every`` hours, ``lag`` hours late.

    A reconcile fires at the first arrival of each cadence cell and shows arrivals up to that time minus the lag.
    """

    every: float = 6.0
    lag: float = 1.0

    name: ClassVar[str] = "lagged_reconcile"
    observed: ClassVar[bool] = True
    cadence: ClassVar[str | None] = "every"

    def _every(self) -> int:
        return hours(max(MIN_CADENCE_HOURS, self.every))

    def _lag(self) -> int:
        return hours(max(0.0, self.lag))

    def _fired(self, log, profile):
        arrival = to_micros("arrival_time")
        return (
            log.filter(F.col("arrival_time").isNotNull())
            .groupBy(profile.grid(self._every()).index_at_or_before(arrival).alias("cell"))
            .agg(F.min(arrival).alias("value"))
        )

    def prepare(self, log, profile, key=KEY):
        grid, lag = profile.grid(self._every()), self._lag()
        fired = self._fired(log, profile)
        cells = Cells(
            _cell_table(fired, 0, grid.size), grid.index_at_or_before(F.col("arrival_us") + F.lit(lag)), grid.size
        )
        marks = fired.select(F.col("value").alias("at_us"), (F.col("value") - lag).alias("cutoff_us"))
        return Prepared(cells, marks)

    def visible(self, profile, row, here, after):
        return _next_at_or_after(row.arrival + F.lit(self._lag()), here, after)

    def loads(self, profile, row, visible, superseded):
        merged = row.live & visible.isNotNull() & (superseded.isNull() | (superseded > visible))
        return F.lit(1) + F.coalesce(merged.cast("int"), F.lit(0))


@dataclass(frozen=True)
class WindowGate(Policy):
    """A change counts only while its event-time window is open: window_end > newest event time - lateness.

    The watermark takes in the whole arrival batch, rejected rows too.  A negative lateness accepts everything.  A row
    without an event time has no window, so it counts only while there is no watermark yet.
    """

    size: float = 24.0
    lateness: float = -1.0

    name: ClassVar[str] = "window_gate"
    observed: ClassVar[bool] = True
    needs_event_time: ClassVar[bool] = True
    cadence: ClassVar[str | None] = "size"

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError("size must be > 0")

    def window_index(self, event: Column) -> Column:
        return floor_div(event, hours(self.size))

    def prepare(self, log, profile, key=KEY):
        """Look up the first arrival at which each window is closed.

        Window w is closed once some row has event_time - lateness >= its end, that is, lies w + 1 windows or more
        up.  So one small aggregate per window replaces a running maximum over all arrivals.
        """
        if self.lateness < 0 or profile.empty:
            return Prepared()
        size, lateness = hours(self.size), hours(self.lateness)
        first, last = (profile.first_event - lateness) // size, profile.last_event // size
        observed = self.observed_events(log, key)
        reached = self.window_index(F.col("event") - F.lit(lateness))
        closing = observed.groupBy(reached.alias("cell")).agg(F.min("arrival").alias("value"))
        # Only windows that hold rows: a stray event time must not make a cell for every window up to it.  The cell
        # before all of them, whose "after" is the first watermark, stands for rows without an event time.
        before, spark = first - 1, log.sparkSession
        used = observed.select(self.window_index(F.col("event")).alias("cell")).distinct()
        used = used.unionByName(spark.range(before, first).select(F.col("id").alias("cell")))
        count = min(last - before + 1, 2 * profile.rows + 1)
        cell = F.coalesce(self.window_index(F.col("event_us")), F.lit(before))
        return Prepared(Cells(_cell_table(closing, before, count, used).filter("cell IS NOT NULL"), cell, count))

    @staticmethod
    def observed_events(log: DataFrame, key: str = KEY) -> DataFrame:
        """The event time of the observed row of each key and arrival, on plain longs, so that it aggregates by hash."""
        return (
            log.select(key, "event_id", to_micros("event_time").alias("event"), to_micros("arrival_time").alias("arrival"))
            .filter(F.col("arrival").isNotNull())
            .groupBy(key, "arrival")
            .agg(F.max_by("event", "event_id").alias("event"))
            .filter(F.col("event").isNotNull())
        )

    def visible(self, profile, row, here, after):
        if self.lateness < 0 or profile.empty:
            return row.arrival
        return F.when(after.isNull() | (row.arrival < after), row.arrival)

    def loads(self, profile, row, visible, superseded):
        return visible.isNotNull().cast("int")


@dataclass(frozen=True)
class CommitSnapshot(Policy):
    """Readers see the log up to the last commit; a commit is due ``every`` hours after the commit before it."""

    every: float = 2.0

    name: ClassVar[str] = "commit_snapshot"
    observed: ClassVar[bool] = True
    cadence: ClassVar[str | None] = "every"

    def commits(self, log: DataFrame, profile: Profile) -> DataFrame:
        return commit_chain(log, self._every(), profile.first_arrival, profile.last_arrival, profile.rows)

    def _every(self) -> int:
        return hours(max(0.0, self.every))

    def prepare(self, log, profile, key=KEY):
        if self._every() == 0:
            return Prepared()
        grid, at = profile.grid(self._every()), F.col("commit_us")
        commits = self.commits(log, profile)
        # Commits are at least one cadence apart, so a cell holds one at most.
        values = commits.select(grid.index_at_or_before(at).alias("cell"), at.alias("value"))
        cells = Cells(_cell_table(values, 0, grid.size), grid.index_at_or_before(F.col("arrival_us")), grid.size)
        return Prepared(cells, commits.select(at.alias("at_us"), at.alias("cutoff_us")))

    def visible(self, profile, row, here, after):
        return row.arrival if self._every() == 0 else _next_at_or_after(row.arrival, here, after)

    def loads(self, profile, row, visible, superseded):
        return F.lit(1)


POLICIES: Mapping[str, type[Policy]] = {
    p.name: p
    for p in (Immediate, FullRefresh, HotWindow, LaggedReconcile, WindowGate, CommitSnapshot, PeriodicSnapshot)
}


def window_finality(log: DataFrame, size: float, lateness: float, profile: Profile | None = None) -> DataFrame:
    """Accepted rows with their window bounds and whether the final watermark has closed the window."""
    from .replay import Replay  # the acceptance rule is the gate's visibility

    gate = WindowGate(size, lateness)
    replay = Replay(log, [gate], profile=profile)
    return replay.accepted_windows(0)
