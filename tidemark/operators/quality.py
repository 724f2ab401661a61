"""Quality of what readers saw: freshness, restatement, accuracy, write amplification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import DAY, HOUR, datetime_of, floor_div, hours, micros_of, ntz, to_micros, to_timestamp
from ..functions.ladder import INDEX_WIDTHS, running, time_widths
from ..functions.measures import as_total
from ..session import materialize
from ..sources.sinks import params_to_json
from .asof import lookup_as_of
from .replay import Replay

# Tolerances of the checks.
ACCURACY_TOLERANCE = 1e-6
FRESHNESS_TOLERANCE_MINUTES = 1e-3
STABILITY_TOLERANCE = 1e-6
VALUE_CHANGE_TOLERANCE = 1e-6
ZERO_TRUTH_TOLERANCE = 1e-6

MINUTE = HOUR // 60


@dataclass(frozen=True)
class Target:
    """Optional thresholds of one scenario; None switches a check off."""

    scenario: str
    description: str = ""
    freshness_target_minutes: float | None = None
    live_accuracy_target_ratio: float | None = None
    daily_window_accuracy_target_ratio: float | None = None
    daily_window_accuracy_delay_hours: float | None = None
    weekly_window_accuracy_target_ratio: float | None = None
    weekly_window_accuracy_delay_hours: float | None = None
    stability_max_revision_ratio: float | None = None

    def daily_bounds(self, at: int) -> tuple[int, int] | None:
        return self._bounds(at, self.daily_window_accuracy_target_ratio, DAY, self.daily_window_accuracy_delay_hours)

    def weekly_bounds(self, at: int) -> tuple[int, int] | None:
        return self._bounds(
            at, self.weekly_window_accuracy_target_ratio, 7 * DAY, self.weekly_window_accuracy_delay_hours
        )

    @staticmethod
    def _bounds(at: int, target: float | None, width: int, delay: float | None) -> tuple[int, int] | None:
        if target is None:
            return None
        end = at - hours(delay or 0.0)
        return end - width, end


# The six standard scenarios.
BASELINE = Target("B0", "Baseline: fixed parameters, no targets")
BUSINESS_TARGETS = (
    Target("S1", "Live sales", 10.0, live_accuracy_target_ratio=0.60),
    Target("S2", "Hourly sales", 60.0, live_accuracy_target_ratio=0.80),
    Target(
        "S3",
        "Daily sales",
        1440.0,
        daily_window_accuracy_target_ratio=0.99,
        daily_window_accuracy_delay_hours=8.0,
    ),
    Target(
        "S4",
        "Weekly review",
        10080.0,
        weekly_window_accuracy_target_ratio=0.999,
        weekly_window_accuracy_delay_hours=0.0,
        stability_max_revision_ratio=0.0,
    ),
    Target(
        "S5",
        "Combined requirements",
        10.0,
        live_accuracy_target_ratio=0.80,
        daily_window_accuracy_target_ratio=0.99,
        daily_window_accuracy_delay_hours=8.0,
        weekly_window_accuracy_target_ratio=0.999,
        weekly_window_accuracy_delay_hours=0.0,
        stability_max_revision_ratio=0.0,
    ),
)
TARGETS = (BASELINE, *BUSINESS_TARGETS)

_TARGET_FIELDS = (
    "freshness_target_minutes",
    "live_accuracy_target_ratio",
    "daily_window_accuracy_target_ratio",
    "daily_window_accuracy_delay_hours",
    "weekly_window_accuracy_target_ratio",
    "weekly_window_accuracy_delay_hours",
    "stability_max_revision_ratio",
)


def targets_of(table: DataFrame) -> list[Target]:
    """The targets of a stored table; it has one row for each scenario of a study."""
    known = [f.name for f in fields(Target) if f.name in table.columns]
    return [Target(**{**r.asDict(), "description": r.asDict().get("description") or ""}) for r in table.select(*known).collect()]


def targets_table(spark: SparkSession, targets: Sequence[Target] = TARGETS) -> DataFrame:
    schema = "scenario string, description string, " + ", ".join(f"{f} double" for f in _TARGET_FIELDS)
    rows = [(t.scenario, t.description, *[getattr(t, f) for f in _TARGET_FIELDS]) for t in targets]
    return spark.createDataFrame(rows, schema)


# -- timelines -----------------------------------------------------------------------------------------------


def metric_rows(timeline: DataFrame, policy: str, metric: str) -> DataFrame:
    """Rows of one policy and metric; none when the timeline lacks them."""
    return timeline.filter((F.col("policy") == policy) & (F.col("metric") == metric))


def normalize_timeline(timeline: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Typed rows, one per (by, arrival_time): the one with the highest event_count.

    Values that do not parse become null; rows without a time are dropped.
    """
    rows = timeline.withColumns(
        {
            "arrival_time": F.col("arrival_time").try_cast("timestamp_ntz"),
            "max_visible_arrival_time": F.col("max_visible_arrival_time").try_cast("timestamp_ntz"),
            "value": F.col("value").try_cast("double"),
        }
    ).filter(F.col("arrival_time").isNotNull())
    keys = [*by, "arrival_time"]
    rest = [c for c in rows.columns if c not in keys]
    # A missing count sorts last, so it is the one that stays.
    order = [F.col("event_count").isNull(), F.col("event_count")] if "event_count" in rows.columns else [F.lit(0)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in timeline.columns])


def align_visibility(
    grid: DataFrame,
    timeline: DataFrame,
    by: str = "policy",
    groups: Sequence[str | int] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(by, arrival_time, max_visible_arrival_time): each group's horizon at every observation point.

    ``groups`` lists the groups; by default it is read from the timeline.
    """
    if groups is None:
        groups = [r[0] for r in timeline.select(by).distinct().collect()]  # one per policy
    label = timeline.schema[by].dataType
    if not groups:
        return timeline.limit(0).select(by, "arrival_time", "max_visible_arrival_time")
    points = grid.select(F.explode(F.array(*[F.lit(g).cast(label) for g in groups])).alias(by), "arrival_time")
    return lookup_as_of(points, timeline, "arrival_time", ["max_visible_arrival_time"], by=[by], rows=rows)


def freshness_lags(aligned: DataFrame, first: datetime | str | None = None, by: str = "policy") -> DataFrame:
    """(by, lag_us, unserved) per observation point; unserved points are measured from the first observation."""
    if first is None:
        first = aligned.agg(F.min("arrival_time")).first()[0]
        if first is None:
            return aligned.select(by, F.lit(0).cast("bigint").alias("lag_us"), F.lit(False).alias("unserved"))
    horizon = F.coalesce(F.col("max_visible_arrival_time"), ntz(first))
    lag = to_micros("arrival_time") - to_micros(horizon)
    return aligned.select(
        by,
        F.greatest(lag, F.lit(0).cast("bigint")).alias("lag_us"),
        F.col("max_visible_arrival_time").isNull().alias("unserved"),
    )


def freshness(
    timeline: DataFrame,
    grid: DataFrame,
    by: str = "policy",
    groups: Sequence[str | int] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Freshness of each group of a normalised timeline over the observation points of a log.

    The timeline should be a stored table: the as-of step reads it several times.  ``rows`` is an upper bound of the
    points of the grid and of one group within any hour, if known.
    """
    first = grid.agg(F.min("arrival_time")).first()[0]
    lags = freshness_lags(align_visibility(grid, timeline, by, groups, rows), first, by)
    return freshness_of(materialize(lags, "lags"), by)


def replay_freshness(replay: Replay, at: datetime | str | None = None) -> DataFrame:
    """Freshness of each run of a replay, without an as-of join or a stored timeline (those serve foreign timelines)."""
    at_us = replay._at(at)
    points = replay.timeline_points().filter(F.col("position") <= at_us).select("slot", "position", "cutoff")
    rows = freshness_of(materialize(replay.visibility_lags(points, at_us), "lags"), by="slot")
    return replay.per_run(rows).select(*replay.labels(), *[c for c in rows.columns if c != "slot"])


def lag_counts(lags: DataFrame, by: str = "policy") -> DataFrame:
    return lags.groupBy(by, "lag_us").agg(F.count(F.lit(1)).alias("n"), F.count_if("unserved").alias("unserved"))


def freshness_of(lags: DataFrame, by: str = "policy", percent: int = 95) -> DataFrame:
    """Largest lag, exact interpolated percentile and number of unserved points per group, in minutes.

    ``lags`` has a row for each point, as a stored table (it is read twice), or is what ``lag_counts`` makes of one.
    The percentile is found by rank: first the minutes that hold the points on both sides of it, by the counts of all
    minutes, then these points by the counts of the lags in these minutes.  So all lags are never sorted or shuffled.
    """
    if "n" not in lags.columns:
        lags = lags.select(by, "lag_us", F.lit(1).cast("bigint").alias("n"), F.col("unserved").cast("bigint").alias("unserved"))
    minute = floor_div(F.col("lag_us"), MINUTE)
    minutes = lags.groupBy(by, minute.alias("minute")).agg(
        F.sum("n").alias("n"), F.sum("unserved").alias("unserved"), F.max("lag_us").alias("longest")
    )
    minutes = materialize(minutes, "lag-minutes")
    totals = minutes.groupBy(by).agg(
        F.sum("n").alias("points"), F.sum("unserved").alias("unserved"), F.max("longest").alias("longest")
    )
    rank = (F.col("points") - 1) * percent
    low = floor_div(rank, 100)
    high = F.least(low + 1, F.col("points") - 1)

    def first_beyond(up_to: Column, rank: Column, position: str) -> Column:
        return F.min(F.when(up_to > rank, F.col(position)))

    up_to = F.col("up_to")
    ranked = running(minutes, F.col("minute"), {"up_to": ("sum", F.col("n"))}, by=[by], at={"n": F.sum("n")}, widths=INDEX_WIDTHS)
    found = ranked.join(F.broadcast(totals), by).groupBy(by, "points", "unserved", "longest").agg(
        first_beyond(up_to, low, "position").alias("_low_minute"),
        first_beyond(up_to, high, "position").alias("_high_minute"),
        F.min(F.when(up_to > low, up_to - F.col("n"))).alias("_before"),
    )
    found = F.broadcast(materialize(found, "lag-ranks"))  # one row for each group
    near = lags.join(found, by).filter(minute.isin(F.col("_low_minute"), F.col("_high_minute")))
    ranked = running(near, F.col("lag_us"), {"up_to": ("sum", F.col("n"))}, by=[by])
    up_to = F.col("_before") + F.col("up_to")
    ranked = ranked.join(found, by).groupBy(by, "points", "unserved", "longest").agg(
        F.pmod(rank, F.lit(100).cast("bigint")).alias("_part"),
        first_beyond(up_to, low, "position").alias("_low"),
        first_beyond(up_to, high, "position").alias("_high"),
    ).withColumnRenamed("unserved", "freshness_unserved_points")
    percentile = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part") / 100
    return ranked.select(
        by,
        (F.col("longest") / MINUTE).alias("freshness_max_minutes"),
        (percentile / MINUTE).alias(f"freshness_p{percent}_minutes"),
        "freshness_unserved_points",
    )


def restatement(timeline: DataFrame, by: str = "policy", rows: int | None = None) -> DataFrame:
    """Changes of the value while the horizon stood still, per group of a normalised timeline.

    A null horizon always counts as moved.  ``rows`` is an upper bound of the rows of a group within any hour, if known.
    """
    horizon = F.col("max_visible_arrival_time")
    steps = running(
        timeline,
        to_micros("arrival_time"),
        {"_value_before": ("last", F.col("value")), "_horizon_before": ("last", horizon)},
        by=[by],
        at={"_value": F.col("value"), "_horizon": horizon},
        strict=True,
        widths=time_widths(rows),
        single=True,
    )
    same = F.coalesce(F.col("_horizon") == F.col("_horizon_before"), F.lit(False))
    change = F.abs(F.col("_value") - F.col("_value_before"))
    restated = same & F.coalesce(change > VALUE_CHANGE_TOLERANCE, F.lit(False))
    counted = steps.groupBy(by).agg(
        F.count_if(same).alias("stability_same_horizon_transitions"),
        F.count_if(restated).alias("stability_revision_count"),
        # Summed as decimals, so that the total does not depend on the order of the rows.
        as_total(F.sum(F.when(restated, change.cast("decimal(28,6)")))).alias("stability_total_abs_change"),
        F.coalesce(F.max(F.when(restated, change)), F.lit(0.0)).alias("stability_max_abs_change"),
    )
    transitions = F.col("stability_same_horizon_transitions")
    return counted.withColumn(
        "stability_revision_ratio",
        F.when(transitions > 0, F.col("stability_revision_count") / transitions).otherwise(F.lit(0.0)),
    )


# -- accuracy ------------------------------------------------------------------------------------------------


def accuracy_delta(truth: Column, served: Column) -> Column:
    return served - truth


def accuracy_ratio(truth: Column, served: Column) -> Column:
    """1 for a perfect match, 0 when off by the truth or more; a zero truth is matched only by zero."""
    return F.when(
        F.abs(truth) <= ZERO_TRUTH_TOLERANCE,
        F.when(F.abs(served) <= ZERO_TRUTH_TOLERANCE, F.lit(1.0)).otherwise(F.lit(0.0)),
    ).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(served - truth) / F.abs(truth)))


Window = tuple[int, int] | None


def accuracy(
    replay: Replay, at: datetime | str | None = None, period: tuple[datetime, datetime] | None = None
) -> DataFrame:
    """Served total against the truth as of a time, per run; over a business period if one is given."""
    window = None if period is None else (micros_of(period[0]), micros_of(period[1]))
    sums = replay.per_run(_served_and_true(replay, replay._at(at), [window]))
    truth, served = F.col("truth_0"), F.col("served_0")
    return sums.select(
        *replay.labels(),
        truth.alias("truth_value"),
        served.alias("served_value"),
        accuracy_delta(truth, served).alias("delta"),
        accuracy_ratio(truth, served).alias("ratio"),
        F.col("truth_rows_0").alias("truth_rows"),
    )


def _served_and_true(replay: Replay, at: int, windows: Sequence[Window], loads: bool = False) -> DataFrame:
    """(slot, served_w, truth_w, truth_rows_w[, rows_loaded_count]): totals over each window as of a time.

    A window is a business period [start, end); None stands for the whole state.
    """

    def inside(w: Window) -> Column:
        return F.lit(True) if w is None else (F.col("event_us") >= w[0]) & (F.col("event_us") < w[1])

    def total(there: Column, w: Window) -> Column:
        return as_total(F.sum(F.when(there & inside(w), F.col("measure_0"))))

    # All sums are columns of one row, which is then cut up: no row of the log is repeated for the policies.
    served = [
        *[total(replay.served_at(i, at), w).alias(f"served_{i}_{n}") for i in range(replay.slots) for n, w in enumerate(windows)],
        *[F.coalesce(F.sum(replay._load(i)), F.lit(0)).alias(f"loads_{i}") for i in range(replay.slots) if loads],
    ]
    true_now = replay._true_at(at)
    truth = [
        *[total(true_now, w).alias(f"truth_{n}") for n, w in enumerate(windows)],
        *[F.count_if(true_now & inside(w)).alias(f"truth_rows_{n}") for n, w in enumerate(windows)],
    ]
    sums = replay.versions.agg(F.count(F.lit(1)).alias("_rows"), *served, *truth).filter("_rows > 0")
    each = [
        F.struct(
            F.lit(i).alias("slot"),
            *[F.col(f"served_{i}_{n}").alias(f"served_{n}") for n in range(len(windows))],
            *([F.col(f"loads_{i}").alias("rows_loaded_count")] if loads else []),
        )
        for i in range(replay.slots)
    ]
    names = [name for n in range(len(windows)) for name in (f"truth_{n}", f"truth_rows_{n}")]
    return sums.select(F.explode(F.array(*each)).alias("_p"), *names).select("_p.*", *names)


# -- outcomes ------------------------------------------------------------------------------------------------


def evaluate(
    replay: Replay, targets: Sequence[Target] | DataFrame = TARGETS, at: datetime | str | None = None
) -> DataFrame:
    """One outcome row per run: targets (objects or a stored table), observed quality and pass flags.

    The versions, the timeline and the lags are each written once, since several aggregates read them.
    """
    if replay.profile.empty:
        raise ValueError("an empty log has no outcomes")
    by_scenario = {t.scenario: t for t in (targets_of(targets) if isinstance(targets, DataFrame) else targets)}
    chosen = [by_scenario.get(r.scenario, Target(r.scenario or "")) for r in replay.runs]
    at_us = replay._at(at)
    replay.materialized()

    points = replay.timeline_points().filter(F.col("position") <= at_us)
    points = materialize(points.select("slot", "position", "cutoff", as_total(F.col("value_0")).alias("value")), "timeline")
    timeline = points.select(
        "slot", to_timestamp("position").alias("arrival_time"), "value", to_timestamp("cutoff").alias("max_visible_arrival_time")
    )
    lags = replay.visibility_lags(points, at_us)

    daily = [t.daily_bounds(at_us) for t in chosen]
    weekly = [t.weekly_bounds(at_us) for t in chosen]
    windows = list(dict.fromkeys([None, *daily, *weekly]))
    rows = (
        _served_and_true(replay, at_us, windows, loads=True)
        .join(freshness_of(lags, by="slot"), "slot", "left")
        .join(restatement(timeline, by="slot", rows=replay.hour_bound), "slot", "left")
    )
    return _outcome_columns(replay.per_run(rows), replay, chosen, at_us, windows, daily, weekly)


def _outcome_columns(
    rows: DataFrame,
    replay: Replay,
    chosen: Sequence[Target],
    at_us: int,
    windows: Sequence[Window],
    daily: Sequence[Window],
    weekly: Sequence[Window],
) -> DataFrame:
    per_run = replay.by_run
    target = {f: per_run([getattr(t, f) for t in chosen], "double") for f in _TARGET_FIELDS}
    params = [F.create_map(*[F.lit(x) for kv in r.policy.params().items() for x in kv]) for r in replay.runs]
    params = F.array(*[p.cast("map<string,double>") for p in params])

    def observed(kind: str, per_run_window: Sequence[Window]) -> Column:
        """The total over the window of the run."""
        totals = F.array(*[F.col(f"{kind}_{n}") for n in range(len(windows))])
        return F.element_at(totals, per_run([windows.index(w) + 1 for w in per_run_window], "int"))

    out = [
        per_run([r.scenario for r in replay.runs], "string").alias("scenario"),
        per_run([r.policy.name for r in replay.runs], "string").alias("policy"),
        params_to_json(F.element_at(params, F.col("run") + 1)).alias("policy_params"),
        F.col("rows_loaded_count"),
        target["freshness_target_minutes"].alias("freshness_target_minutes"),
        F.col("freshness_max_minutes"),
        F.col("freshness_p95_minutes"),
        F.col("freshness_unserved_points"),
        F.when(
            target["freshness_target_minutes"].isNotNull(),
            F.col("freshness_max_minutes") <= target["freshness_target_minutes"] + FRESHNESS_TOLERANCE_MINUTES,
        ).alias("freshness_pass"),
    ]
    everything = [None] * len(chosen)
    for prefix, full, bounds in (
        ("live_accuracy", "live_accuracy", everything),
        ("daily_window", "daily_window_accuracy", daily),
        ("weekly_window", "weekly_window_accuracy", weekly),
    ):
        goal = target[f"{full}_target_ratio"]
        asked = goal.isNotNull()
        truth, served = observed("truth", bounds), observed("served", bounds)
        ratio = accuracy_ratio(truth, served)
        out.append(goal.alias(f"{full}_target_ratio"))
        if bounds is not everything:
            starts, ends = ([None if b is None else b[side] for b in bounds] for side in (0, 1))
            out += [
                target[f"{full}_delay_hours"].alias(f"{full}_delay_hours"),
                to_timestamp(per_run(starts, "bigint")).alias(f"{prefix}_start"),
                to_timestamp(per_run(ends, "bigint")).alias(f"{prefix}_end"),
                F.when(asked, observed("truth_rows", bounds)).alias(f"{prefix}_truth_rows"),
            ]
        out += [
            F.when(asked, truth).alias(f"{prefix}_truth_value"),
            F.when(asked, served).alias(f"{prefix}_served_value"),
            F.when(asked, accuracy_delta(truth, served)).alias(f"{prefix}_delta"),
            F.when(asked, ratio).alias(f"{full}_ratio"),
            F.when(asked, ratio + ACCURACY_TOLERANCE >= goal).alias(f"{full}_pass"),
        ]
    limit = target["stability_max_revision_ratio"]
    asked = limit.isNotNull()
    ratio = F.coalesce(F.col("stability_revision_ratio"), F.lit(0.0))
    out += [
        limit.alias("stability_target_revision_ratio"),
        *[
            F.when(asked, F.coalesce(name, F.lit(0))).alias(name)
            for name in ("stability_same_horizon_transitions", "stability_revision_count")
        ],
        F.when(asked, ratio).alias("stability_revision_ratio"),
        F.when(asked, ratio <= limit + STABILITY_TOLERANCE).alias("stability_pass"),
        F.when(asked, F.lit(True)).alias("stability_evaluable"),
        *[
            F.when(asked, F.coalesce(name, F.lit(0.0))).alias(name)
            for name in ("stability_total_abs_change", "stability_max_abs_change")
        ],
        ntz(datetime_of(at_us)).alias("observation_time"),
    ]
    return rows.select(*out)


def derived_metrics(outcomes: DataFrame, source_rows: int) -> DataFrame:
    """Write amplification and the distance of each observed quality to its target (positive: room left)."""
    rows = max(1, int(source_rows))
    return outcomes.withColumns(
        {
            "source_row_count": F.lit(rows).cast("bigint"),
            "write_amplification": F.col("rows_loaded_count") / float(rows),
            "freshness_headroom_minutes": F.col("freshness_target_minutes") - F.col("freshness_max_minutes"),
            "live_accuracy_headroom_ratio": F.col("live_accuracy_ratio") - F.col("live_accuracy_target_ratio"),
            "daily_window_accuracy_headroom_ratio": F.col("daily_window_accuracy_ratio")
            - F.col("daily_window_accuracy_target_ratio"),
            "weekly_window_accuracy_headroom_ratio": F.col("weekly_window_accuracy_ratio")
            - F.col("weekly_window_accuracy_target_ratio"),
            "stability_headroom_ratio": F.col("stability_target_revision_ratio") - F.col("stability_revision_ratio"),
        }
    )
