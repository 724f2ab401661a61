"""Row-load report, candidate ranking and the pass matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import params_to_json
from .policies import POLICIES
from .replay import Replay

_INFINITE = float("inf")


def row_load_report(loads: DataFrame, numbers: DataFrame) -> DataFrame:
    """Loads with the position of each row in the source."""
    return loads.join(numbers.select("event_id", "source_row_number"), "event_id", "left").select(
        *[c for c in loads.columns if c not in ("event_id", "load_count")],
        "event_id",
        "source_row_number",
        "load_count",
    )


def replay_load_report(replay: Replay, numbers: DataFrame) -> DataFrame:
    """``row_load_report`` of all loads of a replay, numbered before they are given to the runs."""
    return replay.numbered_row_loads(numbers.select("event_id", "source_row_number"))


def distinct_candidates(candidates: DataFrame, by: Sequence[str] = ("scenario", "policy")) -> DataFrame:
    """Drop repeated parameter sets; the first one by (phase, position) stays."""
    first = candidates.withColumn("_json", params_to_json("params")).groupBy(*by, "_json").agg(
        F.min_by(F.struct(*candidates.columns), F.struct("phase", "position")).alias("_row")
    )
    return first.select("_row.*")


def cadence_hours(policy: Column | str = "policy", params: Column | str = "params") -> Column:
    """The parameter that sets how often readers of a policy see news; null for policies without one."""
    policy = F.col(policy) if isinstance(policy, str) else policy
    params = F.col(params) if isinstance(params, str) else params
    cadence = F.lit(None).cast("double")
    for name, kind in POLICIES.items():
        if kind.cadence is not None:
            cadence = F.when(policy == name, params[kind.cadence]).otherwise(cadence)
    return cadence


_CHECKS = (
    # target, observed, pass flag, observed minus target is the miss
    ("freshness_target_minutes", "freshness_max_minutes", "freshness_pass", True),
    ("live_accuracy_target_ratio", "live_accuracy_ratio", "live_accuracy_pass", False),
    (
        "daily_window_accuracy_target_ratio",
        "daily_window_accuracy_ratio",
        "daily_window_accuracy_pass",
        False,
    ),
    (
        "weekly_window_accuracy_target_ratio",
        "weekly_window_accuracy_ratio",
        "weekly_window_accuracy_pass",
        False,
    ),
    ("stability_target_revision_ratio", "stability_revision_ratio", "stability_pass", True),
)


def met_targets() -> Column:
    """All active checks passed; true when there are none."""
    passed = F.lit(True)
    for target, _, flag, _ in _CHECKS:
        passed = passed & (F.col(target).isNull() | F.coalesce(F.col(flag), F.lit(False)))
    return passed


def unmet_gap() -> Column:
    """Sum of the misses of all active checks; infinite when one has no observed value."""
    gap = F.lit(0.0)
    for target, observed, _, upward in _CHECKS:
        miss = F.col(observed) - F.col(target) if upward else F.col(target) - F.col(observed)
        unknown = F.col(observed).isNull() | F.isnan(observed)
        miss = F.when(unknown, F.lit(_INFINITE)).otherwise(F.greatest(F.lit(0.0), miss))
        gap = gap + F.when(F.col(target).isNull(), F.lit(0.0)).otherwise(miss)
    return gap


def candidate_pick(outcomes: DataFrame, by: Sequence[str] = ("scenario", "policy")) -> DataFrame:
    """The chosen candidate per group.

    The first one that meets all targets, base candidates before fallbacks and slow cadences before fast ones;
    without any, the one with the smallest gap.
    """
    scored = outcomes.withColumn("met_target", met_targets()).withColumn("unmet_gap", unmet_gap())
    cadence = F.coalesce(-F.col("cadence_hours"), F.lit(_INFINITE))
    turn = F.struct(F.col("phase"), cadence.alias("cadence"), F.col("position"))
    nothing = F.lit(None)
    order = F.struct(
        (~F.col("met_target")).alias("missed"),
        F.when(F.col("met_target"), turn).otherwise(nothing).alias("turn_if_met"),
        F.col("unmet_gap"),
        F.coalesce("stability_revision_ratio", F.lit(0.0)).alias("stability"),
        turn.alias("turn"),
    )
    best = scored.groupBy(*by).agg(F.min_by(F.struct(*scored.columns), order).alias("_row"))
    return best.select("_row.*")


def pass_matrix(outcomes: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """PASS or FAIL per scenario and policy."""
    status = F.when(met_targets(), "PASS").otherwise("FAIL")
    return outcomes.groupBy("scenario").pivot("policy", list(policies)).agg(F.first(status))
