"""What readers see under each policy: state, value timeline and load counts, from one pass over the log.

A policy gives every row a time at which it becomes visible.  A row counts from then until a newer change of its key
becomes visible.  So per key one window over the newer rows (newest first) yields ``superseded``, the value over
time is a running sum of +measure and -measure at those two times, and no step-by-step replay is needed.
All policies of a replay share the scan, the shuffle by key and its sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import HOUR, ceil_div, hours, micros_of, to_micros, to_timestamp
from ..functions.ladder import running, time_widths
from ..functions.measures import ADDITIVE_MEASURES, MEASURE_LABELS, DistinctCount, Largest, Smallest, as_total, is_live
from ..functions.skew import HOT_ROWS, hot_groups, same_keys, split_hot
from ..session import materialize
from ..sources.changelog import Profile, profile as profile_of
from .policies import Policy, Prepared, Row, WindowGate
from .spans import covering, distinct_counts

TIMELINE_COLUMNS = (
    "policy",
    "metric",
    "arrival_time",
    "event_count",
    "value",
    "value_label",
    "max_visible_arrival_time",
)


def _pick(values: Sequence, kind: str, index: str) -> Column:
    """values[index] as one expression."""

    def literal(v) -> str:
        if v is None:
            return f"CAST(NULL AS {kind})"
        text = v.replace("\\", "\\\\").replace("'", "\\'") if isinstance(v, str) else v
        return f"CAST('{text}' AS {kind})"

    return F.expr(f"element_at(array({', '.join(map(literal, values))}), {index} + 1)")


@dataclass(frozen=True)
class Run:
    """One policy under one scenario."""

    policy: Policy
    scenario: str | None = None


class Replay:
    """Policies applied to one log.

    ``measures`` maps names to additive per-row columns, or to the greatest, least or number of different values of
    one.  The log's size and bounds are read once (``profile``).
    """

    def __init__(
        self,
        log: DataFrame,
        runs: Sequence[Policy | Run],
        *,
        key: str = "sale_id",
        measures: Mapping[str, Column | Largest | Smallest | DistinctCount] | None = None,
        profile: Profile | None = None,
        hot_rows: int = HOT_ROWS,
    ):
        self.log = log
        self.runs = [r if isinstance(r, Run) else Run(r) for r in runs]
        self.key = key
        measures = dict(measures or {n: m() for n, m in ADDITIVE_MEASURES.items()})
        self.measures = {n: m for n, m in measures.items() if isinstance(m, Column)}
        self.lasting = {n: m for n, m in measures.items() if n not in self.measures}
        self.hot_rows = hot_rows
        gated = any(r.policy.needs_event_time for r in self.runs)
        self.profile = profile if profile is not None else profile_of(log, event_bounds=gated)

    # -- rows ------------------------------------------------------------------------------------------------

    @cached_property
    def _distinct_policies(self) -> list[Policy]:
        """Equal policies of several runs are computed once."""
        return list(dict.fromkeys(r.policy for r in self.runs))

    @property
    def slots(self) -> int:
        return len(self._distinct_policies)

    def _slot(self, run: int) -> int:
        return self._distinct_policies.index(self.runs[run].policy)

    @cached_property
    def _prepared(self) -> list[Prepared]:
        return [p.prepare(self.log, self.profile, self.key) for p in self._distinct_policies]

    @cached_property
    def versions(self) -> DataFrame:
        """Every row with is_observed, next_arrival_us and, per distinct policy i, visible_i and superseded_i."""
        has_event_time = "event_time" in self.log.columns
        rows = self.log.filter(F.col("arrival_time").isNotNull()).select(
            "event_id",
            self.key,
            to_micros("arrival_time").alias("arrival_us"),
            *([to_micros("event_time").alias("event_us")] if has_event_time else []),
            is_live().alias("live"),
            *[m.alias(f"measure_{i}") for i, m in enumerate(self.measures.values())],
            *[m.column.alias(f"lasting_{i}") for i, m in enumerate(self.lasting.values())],
        )
        kept = rows.columns
        for i, prepared in enumerate(self._prepared):
            if prepared.cells is not None:
                rows = prepared.cells.attach(rows, f"look_{i}")
        visible = []
        for i, (policy, prepared) in enumerate(zip(self._distinct_policies, self._prepared)):
            looked = prepared.cells is not None
            here, after = (F.col(f"look_{i}_here"), F.col(f"look_{i}_after")) if looked else (F.lit(None), F.lit(None))
            visible.append(policy.visible(self.profile, Row(), here, after).cast("bigint").alias(f"visible_{i}"))
        rows = rows.select(*kept, *visible)

        groups = hot_groups(self.log, [self.key], self.profile.rows, self.hot_rows)
        if groups is None:
            return self._by_window(rows)
        cold, hot = split_hot(rows, [self.key], self.profile.rows, self.hot_rows, groups)
        # The ladder reads its rows several times; written once, the log is evaluated twice in all.
        return self._by_window(cold).unionByName(self._by_ladder(materialize(hot, "hot-rows")))

    def _observed_only(self, rows: DataFrame) -> DataFrame:
        """Policies that read the deduplicated log never see the other rows."""
        return rows.withColumns(
            {
                f"visible_{i}": F.when(F.col("is_observed"), F.col(f"visible_{i}"))
                for i, p in enumerate(self._distinct_policies)
                if p.observed
            }
        )

    def _by_window(self, rows: DataFrame) -> DataFrame:
        newest_first = Window.partitionBy(self.key).orderBy(F.col("arrival_us").desc(), F.col("event_id").desc())
        newer = newest_first.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("next_arrival_us", F.lag("arrival_us").over(newest_first))
        rows = rows.withColumn("is_observed", ~F.col("arrival_us").eqNullSafe(F.col("next_arrival_us")))
        rows = self._observed_only(rows)
        return rows.withColumns(
            {f"superseded_{i}": F.min(f"visible_{i}").over(newer) for i in range(len(self._distinct_policies))}
        )

    def _by_ladder(self, rows: DataFrame) -> DataFrame:
        """The same for keys with too many rows for one task: the window over a key becomes a running minimum.

        Of the rows with one key and arrival only the one with the highest event_id can count; the others are
        superseded as soon as they are visible.
        """
        n = len(self._distinct_policies)
        newest = F.max("event_id").over(Window.partitionBy(self.key, "arrival_us"))
        rows = self._observed_only(rows.withColumn("is_observed", F.col("event_id") == newest))
        newer = running(
            rows,
            F.col("arrival_us"),
            {
                "next_arrival_us": ("min", F.col("arrival_us")),
                **{f"superseded_{i}": ("min", F.col(f"visible_{i}")) for i in range(n)},
            },
            by=[self.key],
            at={"event_id": F.max("event_id")},
            strict=True,
            reverse=True,
            widths=time_widths(self.profile.rows),
        ).drop("event_id")
        newer = newer.select(F.col(self.key).alias(f"_of_{self.key}"), F.col("position").alias("_of_arrival_us"), *newer.columns[2:])
        columns = [*rows.columns, *newer.columns[2:]]
        rows = rows.join(newer, same_keys(rows, newer, [self.key, "arrival_us"], "_of_"), "left").select(*columns)
        rows = rows.withColumn(
            "next_arrival_us", F.when(F.col("is_observed"), F.col("next_arrival_us")).otherwise(F.col("arrival_us"))
        )
        rows = rows.withColumns(
            {
                f"superseded_{i}": F.when(F.col("is_observed"), F.col(f"superseded_{i}")).otherwise(
                    F.col(f"visible_{i}")
                )
                for i in range(n)
            }
        )
        return rows

    def materialized(self) -> Replay:
        """Write the versions to reliable storage, for several reads of them."""
        self.__dict__["versions"] = materialize(self.versions, "versions")
        if self._marks is not None:
            self.__dict__["_marks"] = materialize(self._marks, "marks")
        return self

    @staticmethod
    def _counts(i: int) -> Column:
        """The row is part of the state for a while."""
        visible, superseded = F.col(f"visible_{i}"), F.col(f"superseded_{i}")
        return F.col("live") & visible.isNotNull() & (superseded.isNull() | (visible < superseded))

    def served_at(self, i: int, at: int) -> Column:
        """The row is part of the state of a distinct policy at a time."""
        superseded = F.col(f"superseded_{i}")
        return self._counts(i) & (F.col(f"visible_{i}") <= at) & (superseded.isNull() | (superseded > at))

    def _true_at(self, at: int) -> Column:
        following = F.col("next_arrival_us")
        return F.col("live") & (F.col("arrival_us") <= at) & (following.isNull() | (following > at))

    @property
    def timeline_bound(self) -> int:
        """No policy has more observation points than this."""
        grids = [p.grid(self.profile) for p in self._distinct_policies]
        return max([self.profile.rows, *[g.size for g in grids if g is not None]])

    @property
    def hour_bound(self) -> int:
        """No policy has more positions than this within an hour: arrivals, grid points, and nothing in between.

        Without the log's densest hour: than this in all, as a row adds up to three positions, and marks come on top.
        """
        grids = [g for p in self._distinct_policies if (g := p.grid(self.profile)) is not None]
        points = max((g.size for g in grids), default=0)
        if self.profile.densest_hour is None:
            return 4 * self.profile.rows + points
        return self.profile.densest_hour + min(points, max((HOUR // g.step + 1 for g in grids), default=0))

    # -- labels ----------------------------------------------------------------------------------------------

    def _by_slot(self, values: Sequence, kind: str) -> Column:
        """A constant per distinct policy, picked by the column ``slot``."""
        return _pick(values, kind, "slot")

    def per_run(self, rows: DataFrame) -> DataFrame:
        """Give rows of a distinct policy (``slot``) to every run that uses it (``run``)."""
        runs: list[list[int]] = [[] for _ in self._distinct_policies]
        for run in range(len(self.runs)):
            runs[self._slot(run)].append(run)
        of_slot = F.expr(f"element_at(array({', '.join(f'array({", ".join(map(str, rs))})' for rs in runs)}), slot + 1)")
        return rows.withColumn("run", F.explode(of_slot)).drop("slot")

    def by_run(self, values: Sequence, kind: str) -> Column:
        """A constant per run, picked by the column ``run``."""
        return _pick(values, kind, "run")

    def labels(self) -> list[Column]:
        """scenario (when the runs have one) and policy of the column ``run``."""
        scenarios = [r.scenario for r in self.runs]
        named = [] if all(s is None for s in scenarios) else [self.by_run(scenarios, "string").alias("scenario")]
        return [*named, self.by_run([r.policy.name for r in self.runs], "string").alias("policy")]

    def per_policy(self, *columns: str, loads: bool = False) -> DataFrame:
        """Version rows once per distinct policy: slot, visible, superseded (null unless the row counts), load."""
        structs = []
        for i in range(len(self._distinct_policies)):
            counts = self._counts(i)
            fields = [
                F.lit(i).alias("slot"),
                F.when(counts, F.col(f"visible_{i}")).alias("visible"),
                F.when(counts, F.col(f"superseded_{i}")).alias("superseded"),
            ]
            if loads:
                fields.append(self._load(i).alias("load_count"))
            structs.append(F.struct(*fields))
        return self.versions.select(*columns, F.explode(F.array(*structs)).alias("_p")).select(*columns, "_p.*")

    # -- timeline --------------------------------------------------------------------------------------------

    def _regular_points(self) -> DataFrame:
        """(slot, at_us) of every regular grid, numbered through as one range."""
        grids = {i: g for i, p in enumerate(self._distinct_policies) if (g := p.grid(self.profile)) is not None}
        slot, first, total = F.lit(None), F.lit(None), 0
        for i, g in grids.items():  # later grids start at later ids
            inside = F.col("id") >= total
            slot, first = F.when(inside, i).otherwise(slot), F.when(inside, total).otherwise(first)
            total += g.size
        steps = [grids[i].step if i in grids else None for i in range(len(self._distinct_policies))]
        start = next(iter(grids.values())).start if grids else 0
        points = self.log.sparkSession.range(total).select(
            slot.cast("int").alias("slot"), (F.col("id") - first.cast("bigint")).alias("index")
        )
        return points.select("slot", (F.lit(start) + F.col("index") * self._by_slot(steps, "bigint")).alias("at_us"))

    @cached_property
    def _marks(self) -> DataFrame | None:
        """(slot, at_us, cutoff) of the policies whose cutoff moves at times of its own."""
        marks = None
        for i, prepared in enumerate(self._prepared):
            if prepared.marks is not None:
                rows = prepared.marks.select(F.lit(i).alias("slot"), "at_us", F.col("cutoff_us").alias("cutoff"))
                marks = rows if marks is None else marks.unionByName(rows)
        return marks

    def timeline_points(self) -> DataFrame:
        """(slot, position, event_count, value_m, cutoff) at every observation point of every distinct policy."""
        policies = self._distinct_policies
        grids = [p.grid(self.profile) for p in policies]
        amounts = [f"measure_{m}" for m in range(len(self.measures))]
        rows = self.per_policy("arrival_us", "is_observed", *amounts)

        # Where a row is counted as seen: its arrival, or the grid point that first takes it in.
        arrival = F.col("arrival_us")
        step = self._by_slot([None if g is None else g.step for g in grids], "bigint")
        origin, end = (0, -1) if self.profile.empty else (self.profile.first_arrival, self.profile.last_arrival)
        snapped = F.lit(origin) + ceil_div(arrival - F.lit(origin), step) * step
        seen_at = F.when(step.isNull(), arrival).otherwise(F.when(snapped <= end, snapped))
        reads_all = ~self._by_slot([p.observed for p in policies], "boolean")
        seen_at = F.when(reads_all | F.col("is_observed"), seen_at)
        own_cutoff = self._by_slot([g is None and m.marks is None for g, m in zip(grids, self._prepared)], "boolean")

        types = [self.versions.schema[a].dataType for a in amounts]

        def point(at: Column, seen: int, value: list[Column], observed: Column, cutoff: Column) -> Column:
            return F.struct(
                at.alias("at_us"),
                F.lit(seen).cast("bigint").alias("seen"),
                *[v.cast(t).alias(f"value_{m}") for m, (v, t) in enumerate(zip(value, types))],
                observed.alias("observed"),
                cutoff.alias("cutoff"),
            )

        none = F.lit(None).cast("bigint")
        # Most rows come into view where they are counted: one point instead of two.
        apart = F.col("_seen_at").isNull() | (F.col("visible") != F.col("_seen_at"))
        shown = [F.when(F.col("visible") == F.col("_seen_at"), F.col(a)) for a in amounts]
        rows = rows.withColumn("_seen_at", seen_at)
        points = F.array(
            point(F.col("_seen_at"), 1, shown, step.isNull(), F.when(own_cutoff, arrival)),
            point(F.when(apart, F.col("visible")), 0, [F.col(a) for a in amounts], F.lit(False), none),
            point(F.col("superseded"), 0, [-F.col(a) for a in amounts], F.lit(False), none),
        )
        rows = rows.select("slot", F.explode(points).alias("_q")).select("slot", "_q.*")
        rows = rows.filter(F.col("at_us").isNotNull())
        if any(g is not None for g in grids):
            regular = self._regular_points().select("slot", "at_us", F.lit(True).alias("observed"), F.col("at_us").alias("cutoff"))
            rows = rows.unionByName(regular, allowMissingColumns=True)
        if self._marks is not None:
            rows = rows.unionByName(self._marks, allowMissingColumns=True)
        found = running(
            rows,
            F.col("at_us"),
            {
                "event_count": ("sum", F.col("seen")),
                **{f"value_{m}": ("sum", F.col(f"value_{m}")) for m in range(len(amounts))},
                "cutoff": ("max", F.col("cutoff")),
            },
            by=["slot"],
            at={"observed": F.max("observed")},
            widths=self._widths,
            bound=None if None in grids else max((g.size for g in grids), default=0),
        )
        return found.filter("observed").withColumn("event_count", F.coalesce("event_count", F.lit(0)))

    def visibility_lags(self, points: DataFrame, at: int) -> DataFrame:
        """(slot, lag_us, unserved) at every distinct arrival up to a time, given the stored timeline points.

        A policy seen at each arrival has a point there.  Behind a regular grid the lag is the distance to the grid
        point before, so no as-of join is needed.
        """
        seen = points.select(
            "slot",
            F.greatest(F.col("position") - F.coalesce("cutoff", F.lit(self.profile.first_arrival)), F.lit(0)).alias("lag_us"),
            F.col("cutoff").isNull().alias("unserved"),
        )
        grids = [p.grid(self.profile) for p in self._distinct_policies]
        regular = [i for i, g in enumerate(grids) if g is not None]
        if not regular:
            return seen
        steps = F.expr(f"explode(array({', '.join(f'struct({i} AS slot, {grids[i].step}L AS step)' for i in regular)}))")
        # Written once: they are read more than once, each time as one row for each regular policy.
        arrivals = materialize(self.versions.filter(F.col("arrival_us") <= at).select("arrival_us").distinct(), "arrivals")
        since = F.col("arrival_us") - F.lit(self.profile.first_arrival)
        behind = arrivals.select(since.alias("_since"), steps.alias("_g")).select(
            F.col("_g.slot").alias("slot"), F.pmod(F.col("_since"), F.col("_g.step")).alias("lag_us"), F.lit(False).alias("unserved")
        )
        return seen.filter(~F.col("slot").isin(regular)).unionByName(behind)

    @property
    def _widths(self) -> tuple[int, int]:
        """Slots for the positions of one policy."""
        return time_widths(self.hour_bound)

    def _lasting_points(self, points: DataFrame) -> DataFrame:
        """(slot, position, metric, value, value_label) of the measures that rows cannot be subtracted from."""
        names = list(self.lasting)
        spans = self.per_policy(*[f"lasting_{i}" for i in range(len(names))])
        start, end = F.col("visible"), F.col("superseded")
        kinds = {Largest: "max", Smallest: "min"}
        extremes = {n: (kinds[type(m)], F.col(f"lasting_{i}")) for i, (n, m) in enumerate(self.lasting.items()) if type(m) in kinds}
        found = []
        if extremes:
            found.append((covering(spans, points, start, end, extremes, by=["slot"], widths=self._widths), list(extremes)))
        for i, (name, measure) in enumerate(self.lasting.items()):
            if isinstance(measure, DistinctCount):
                value = F.col(f"lasting_{i}")
                found.append((distinct_counts(spans, points, start, end, value, name, by=["slot"], widths=self._widths), [name]))
        rows = None
        for values, metrics in found:
            each = F.array(
                *[
                    F.struct(
                        F.lit(n).alias("metric"),
                        F.col(f"`{n}`").cast("double").alias("value"),
                        F.lit(MEASURE_LABELS.get(n, self.lasting[n].label)).alias("value_label"),
                    )
                    for n in metrics
                ]
            )
            values = values.select("slot", "position", F.explode(each).alias("_m")).filter(F.col("_m.value").isNotNull())
            rows = values if rows is None else rows.unionByName(values)
        return rows

    def timeline(self) -> DataFrame:
        """One row per run, measure and observation point: the served value and how far it reaches.

        A measure without a value at a point, such as a maximum of nothing, has no row there.
        """
        points, lasting = self.timeline_points(), None
        if self.lasting:
            points = materialize(points, "points")
            lasting = self._lasting_points(points.select("slot", "position"))
            lasting = points.select("slot", "position", "event_count", "cutoff").join(lasting, ["slot", "position"])
        measures = F.array(
            *[
                F.struct(
                    F.lit(name).alias("metric"),
                    as_total(F.col(f"value_{m}")).alias("value"),
                    F.lit(MEASURE_LABELS.get(name, name)).alias("value_label"),
                )
                for m, name in enumerate(self.measures)
            ]
        )
        rows = None
        if self.measures:
            rows = points.select("slot", "position", "event_count", "cutoff", F.explode(measures).alias("_m"))
        if lasting is not None:
            rows = lasting if rows is None else rows.unionByName(lasting)
        rows = self.per_run(rows).select(
            *self.labels(),
            to_timestamp("position").alias("arrival_time"),
            F.col("event_count"),
            "_m",
            to_timestamp("cutoff").alias("max_visible_arrival_time"),
        )
        labels = [c for c in ("scenario", "policy") if c in rows.columns]
        return rows.select(
            *labels, "_m.metric", "arrival_time", "event_count", "_m.value", "_m.value_label",
            "max_visible_arrival_time",
        )

    # -- loads -----------------------------------------------------------------------------------------------

    def _load(self, i: int) -> Column:
        policy = self._distinct_policies[i]
        count = policy.loads(self.profile, Row(), F.col(f"visible_{i}"), F.col(f"superseded_{i}")).cast("bigint")
        return F.when(F.col("is_observed"), count).otherwise(F.lit(0)) if policy.observed else count

    def row_loads(self) -> DataFrame:
        """(policy, event_id, load_count) of every row that a policy writes at all."""
        rows = self.per_policy("event_id", loads=True).filter(F.col("load_count") > 0)
        return self.per_run(rows).select(*self.labels(), "event_id", "load_count")

    def numbered_row_loads(self, numbers: DataFrame) -> DataFrame:
        """``row_loads`` with the columns that ``numbers`` has beside event_id, after event_id.

        They are joined while a log row is one row, not one for each run.
        """
        loads = [F.struct(F.lit(i).alias("slot"), self._load(i).alias("load_count")) for i in range(self.slots)]
        loaded = F.filter(F.array(*loads), lambda load: load["load_count"] > 0)
        rows = self.versions.select("event_id", loaded.alias("_loads")).filter(F.size("_loads") > 0)
        added = [c for c in numbers.columns if c != "event_id"]
        rows = rows.join(numbers, "event_id", "left").select("event_id", *added, F.explode("_loads").alias("_l"))
        return self.per_run(rows.select("event_id", *added, "_l.*")).select(*self.labels(), "event_id", *added, "load_count")

    def rows_loaded(self) -> DataFrame:
        """Rows written per run, repeated writes counted each time."""
        rows = self.per_policy(loads=True).groupBy("slot").agg(
            F.coalesce(F.sum("load_count"), F.lit(0)).alias("rows_loaded_count")
        )
        return self.per_run(rows).select(*self.labels(), "rows_loaded_count")

    # -- state -----------------------------------------------------------------------------------------------

    def served(self, run: int = 0, at: datetime | str | None = None) -> DataFrame:
        """Log rows that make up the state of a run at a time (default: the last arrival)."""
        i, at_us = self._slot(run), self._at(at)
        served = self.versions.filter(self.served_at(i, at_us)).select("event_id")
        return self.log.join(served, "event_id", "left_semi")

    def _at(self, at: datetime | str | None) -> int:
        if at is not None:
            return micros_of(at)
        return 0 if self.profile.empty else self.profile.last_arrival

    def accepted_windows(self, run: int = 0) -> DataFrame:
        """Rows a window gate let in, with their window and whether the last watermark has closed it."""
        gate = self.runs[run].policy
        if not isinstance(gate, WindowGate):
            raise TypeError("only a window gate assigns windows")
        i = self._slot(run)
        start = gate.window_index(F.col("event_us")) * hours(gate.size)
        end = start + F.lit(hours(gate.size))
        rows = self.versions.filter(F.col(f"visible_{i}").isNotNull()).select(
            "event_id",
            self.key,
            to_timestamp("event_us").alias("event_time"),
            to_timestamp("arrival_us").alias("arrival_time"),
            to_timestamp(start).alias("window_start"),
            to_timestamp(end).alias("window_end"),
            end.alias("_end"),
        )
        if gate.lateness < 0:
            return rows.withColumn("is_final", F.lit(False)).drop("_end")
        newest = gate.observed_events(self.log, self.key).agg(F.max("event")).first()[0]  # one number
        watermark = F.lit(None if newest is None else newest - hours(gate.lateness)).cast("bigint")
        return rows.withColumn("is_final", F.col("_end") <= watermark).drop("_end")
