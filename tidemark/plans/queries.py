"""The registered queries: every operator over the whole change log (or another whole table)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import measures as M
from ..functions.clock import hours, to_micros, to_timestamp
from ..operators import asof, calendar, maintain, policies as P, quality as Q, reports, sequence, views
from ..operators.kept import KeptTimeline
from ..operators.keyed_table import KeyedTable
from ..operators.replay import Replay, Run
from ..session import materialize, scratch_path
from ..sources import changelog as C, sinks, snapshots
from ..streaming import gate, jobs, keyed, landing

Query = Callable[[SparkSession, str], DataFrame]

AT = "2024-01-25 00:00:00"
EARLIER = "2024-01-20 00:00:00"
CUTS = ("2024-01-12 00:00:00", AT)

REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Six digits for every double, so that results compare across engines."""
    return df.select(
        *[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema]
    )


# -- sources and sinks ---------------------------------------------------------------------------------------


@query
def changelog(spark, d):
    return C.changelog(spark, d)


@query
def source_profile(spark, d):
    return C.source_profile(C.changelog(spark, d))


@query
def arrival_bounds(spark, d):
    return C.arrival_bounds(C.changelog(spark, d))


@query
def unique_arrivals(spark, d):
    """Arrivals cut to the hour first, so that there are ties to break."""
    log = C.changelog(spark, d, ["event_id", "sale_id", "arrival_time"])
    log = log.withColumn("arrival_time", F.date_trunc("hour", "arrival_time").cast("timestamp_ntz"))
    return C.unique_arrivals(log)


@query
def stored_log_as_of(spark, d):
    """Write the log by arrival date and read back the part up to a time."""
    path = scratch_path(spark, "log")
    sinks.save_log(C.changelog(spark, d), path)
    return C.read_log(spark, path, until=AT)


@query
def stored_log_increment(spark, d):
    """A log stored in two batches, read back as one increment."""
    path = scratch_path(spark, "log")
    log = C.changelog(spark, d)
    sinks.save_log(views.as_of(log, EARLIER), path)
    sinks.save_log(log.filter(F.col("arrival_time") > F.lit(EARLIER).cast("timestamp_ntz")), path, mode="append")
    return C.read_log(spark, path, after=EARLIER, until=AT)


@query
def saved_results(spark, d):
    """The three result tables of a small study as CSV; the row loads are read back."""
    log = C.changelog(spark, d)
    replay = Replay(log, [Run(P.FullRefresh(76), "S4")])
    loads = reports.replay_load_report(replay, sequence.source_row_number(log, replay.profile.rows))
    outcomes = Q.evaluate(replay, at=AT)
    root = scratch_path(spark, "results")
    sinks.save_results(root, replay.timeline(), outcomes, loads)
    schema = T.StructType([*loads.schema.fields, T.StructField("run_type", T.StringType())])
    return sinks.read_csv(spark, f"{root}/row_loads", schema)


@query
def saved_snapshots(spark, d):
    """The timeline of a small study, stored with the other result tables and read back."""
    log = C.changelog(spark, d)
    replay = Replay(log, [Run(P.FullRefresh(76), "S4")])
    timeline = replay.timeline()
    loads = reports.replay_load_report(replay, sequence.source_row_number(log, replay.profile.rows))
    root = scratch_path(spark, "results")
    sinks.save_results(root, timeline, Q.evaluate(replay, at=AT), loads)
    schema = T.StructType([*timeline.schema.fields, T.StructField("run_type", T.StringType())])
    return rounded(sinks.read_csv(spark, f"{root}/snapshots", schema))


@query
def csv_export(spark, d):
    """The log as CSV with a header, read back."""
    path = scratch_path(spark, "csv")
    sinks.save_csv(C.changelog(spark, d), path)
    return sinks.read_csv(spark, path, C.LOG_SCHEMA)


@query
def registered_relation(spark, d):
    C.register(C.changelog(spark, d), "change_log")
    return spark.sql(
        "SELECT country, count(*) AS changes, count_if(is_deleted) AS deletes FROM change_log GROUP BY country"
    )


@query
def parameter_json(spark, d):
    """Parameters as JSON with sorted keys, and parsed back."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey",
        F.create_map(
            F.lit("total"), F.col("o_totalprice"), F.lit("customer"), F.col("o_custkey").cast("double")
        ).alias("params"),
    )
    rows = rows.select("o_orderkey", sinks.params_to_json("params").alias("json"))
    parsed = sinks.params_from_json("json")
    return rows.select(
        "o_orderkey",
        "json",
        parsed["total"].alias("total"),
        parsed["customer"].alias("customer"),
    )


# -- views and truths ----------------------------------------------------------------------------------------


@query
def snapshot_as_of(spark, d):
    return views.snapshot_as_of(C.changelog(spark, d), AT)


@query
def snapshot_from_stored(spark, d):
    """The state as of a time from the newest stored state and the tail of a stored log."""
    root = scratch_path(spark, "states")
    sinks.save_log(C.changelog(spark, d), f"{root}/log")
    for at in (CUTS[0], EARLIER):
        snapshots.store_state(spark, f"{root}/log", f"{root}/states", at)
    return snapshots.state_as_of(spark, f"{root}/log", f"{root}/states", AT)


@query
def latest_rows(spark, d):
    return views.latest_rows(C.changelog(spark, d))


@query
def total_sales_live(spark, d):
    return rounded(M.total_sales(views.snapshot_as_of(C.changelog(spark, d))))


@query
def captured_measures(spark, d):
    return rounded(M.capture(views.snapshot_as_of(C.changelog(spark, d), AT)))


@query
def summarized_measure(spark, d):
    """A measure without a value column: the mean of its first numeric column that is no id."""
    served = views.snapshot_as_of(C.changelog(spark, d), AT)
    per_country = served.groupBy("country").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(M.sales_amount()).cast("double").alias("revenue")
    )
    return rounded(M.summarize_measure("revenue_by_country", per_country))


@query
def max_visible_arrival(spark, d):
    return M.max_visible_arrival(views.snapshot_as_of(C.changelog(spark, d), AT))


@query
def observed_log(spark, d):
    """Arrivals cut to the day, so that keys change several times in one arrival."""
    log = C.changelog(spark, d)
    log = log.withColumn("arrival_time", F.date_trunc("day", "arrival_time").cast("timestamp_ntz"))
    return views.observed_log(log)


@query
def observation_grid(spark, d):
    return views.observation_grid(C.changelog(spark, d, ["arrival_time"]), AT)


@query
def increment(spark, d):
    return views.increment(C.changelog(spark, d), EARLIER, AT)


@query
def arrived_between(spark, d):
    return views.arrived_between(C.changelog(spark, d), EARLIER, AT)


def _an_arrival(log: DataFrame):
    """An arrival of the log, as a bound that tells closed ranges from half-open ones."""
    return views.as_of(log, "2024-01-22 00:00:00").agg(F.max("arrival_time")).first()[0]


@query
def arrived_from_an_arrival(spark, d):
    log = C.changelog(spark, d)
    return views.arrived_between(log, _an_arrival(log), AT)


@query
def increment_from_an_arrival(spark, d):
    log = C.changelog(spark, d)
    return views.increment(log, _an_arrival(log), AT)


@query
def changed_keys(spark, d):
    return views.changed_keys(views.increment(C.changelog(spark, d, ["sale_id", "arrival_time"]), EARLIER, AT))


@query
def truth_total_as_of(spark, d):
    return rounded(views.truth_total(C.changelog(spark, d), AT))


@query
def truth_daily(spark, d):
    return rounded(views.truth_period(C.changelog(spark, d), *views.daily_window(AT, 8), AT))


@query
def truth_weekly(spark, d):
    return rounded(views.truth_period(C.changelog(spark, d), *views.weekly_window(AT), AT))


# -- orders, prefixes and as-of joins ------------------------------------------------------------------------


@query
def source_row_number(spark, d):
    log = C.changelog(spark, d, ["event_id", "arrival_time"])
    return sequence.source_row_number(log, log.count()).select("event_id", "source_row_number")


@query
def source_row_number_tied(spark, d):
    """Arrivals cut to the day and a low limit: the numbering inside large tied arrivals."""
    log = C.changelog(spark, d, ["event_id", "arrival_time"])
    log = log.withColumn("arrival_time", F.date_trunc("day", "arrival_time").cast("timestamp_ntz"))
    return sequence.source_row_number(log, log.count(), hot_rows=200).select("event_id", "source_row_number")


@query
def running_event_count(spark, d):
    return sequence.running_event_count(C.changelog(spark, d, ["arrival_time"]))


@query
def row_watermark(spark, d):
    return sequence.row_watermark(C.changelog(spark, d, ["arrival_time", "event_time"]))


def _hourly(spark, d):
    """Change count and newest change per hour of arrival and country."""
    log = C.changelog(spark, d, ["event_id", "arrival_time", "country"])
    hour = F.date_trunc("hour", "arrival_time").cast("timestamp_ntz")
    return log.groupBy("country", hour.alias("arrival_time")).agg(F.max("event_id").alias("newest"))


@query
def asof_backward(spark, d):
    """Each change takes the last non-empty hour of its country at or before its own half hour mark."""
    log = C.changelog(spark, d, ["event_id", "arrival_time", "country"])
    return asof.asof_join(log, _hourly(spark, d), "arrival_time", ["newest"], by=["country"])


@query
def asof_forward(spark, d):
    log = C.changelog(spark, d, ["event_id", "arrival_time", "country"])
    joined = asof.asof_join(log, _hourly(spark, d), "arrival_time", ["newest"], by=["country"], direction="forward")
    return joined.withColumn("newest", F.coalesce("newest", F.lit(-1)))


# -- policies ------------------------------------------------------------------------------------------------


def _timeline(policy: P.Policy, **options) -> Query:
    return lambda spark, d: rounded(Replay(C.changelog(spark, d), [policy], **options).timeline())


def _loads(*chosen: P.Policy) -> Query:
    return lambda spark, d: Replay(C.changelog(spark, d), list(chosen)).row_loads()


TIMELINES: dict[str, P.Policy] = {
    "timeline_immediate": P.Immediate(),
    "timeline_full_refresh": P.FullRefresh(6),
    "timeline_full_refresh_10min": P.FullRefresh(0.166667),
    "timeline_periodic_snapshot": P.PeriodicSnapshot(76),
    "timeline_hot_window": P.HotWindow(hot=24, every=36, full_every=120),
    "timeline_hot_window_fast": P.HotWindow(hot=96, every=24, full_every=240),
    "timeline_reconcile": P.LaggedReconcile(every=12, lag=5),
    "timeline_reconcile_hourly": P.LaggedReconcile(every=1, lag=0),
    "timeline_window_gate": P.WindowGate(size=6, lateness=12),
    "timeline_window_gate_wide": P.WindowGate(size=228, lateness=114),
    "timeline_window_gate_open": P.WindowGate(size=6, lateness=-1),
    "timeline_commit": P.CommitSnapshot(every=8),
    "timeline_commit_always": P.CommitSnapshot(every=0),
}
for _name, _policy in TIMELINES.items():
    REGISTRY[_name] = _timeline(_policy)

# The same results with keys of more than two changes handled as hot keys.
REGISTRY["timeline_immediate_hot_keys"] = _timeline(P.Immediate(), hot_rows=2)
REGISTRY["timeline_hot_window_hot_keys"] = _timeline(P.HotWindow(hot=24, every=36, full_every=120), hot_rows=2)



def _tied_log(spark, d):
    """Arrivals cut to the day, so that many tie, and each change with an event time of its own."""
    own = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("event_time"))
    log = C.changelog(spark, d, [c for c in C.EVENT_COLUMNS if c != "event_time"]).join(own, "event_id")
    log = log.withColumn("arrival_time", F.date_trunc("day", "arrival_time").cast("timestamp_ntz"))
    return log.select(*C.EVENT_COLUMNS)


def _tied(policy: P.Policy, what: str, hot_rows: int) -> Query:
    def run(spark, d):
        replay = Replay(_tied_log(spark, d), [policy], hot_rows=hot_rows)
        return rounded(getattr(replay, what)())

    return run


for _name, _policy in {
    "window_gate": P.WindowGate(size=6, lateness=12),
    "reconcile": P.LaggedReconcile(every=12, lag=5),
    "commit": P.CommitSnapshot(every=8),
}.items():
    REGISTRY[f"timeline_{_name}_hot_keys"] = _tied(_policy, "timeline", 2)
    REGISTRY[f"loads_{_name}_hot_keys"] = _tied(_policy, "row_loads", 2)
    REGISTRY[f"timeline_{_name}_tied"] = _tied(_policy, "timeline", 10**6)

CATEGORIES = ("Electronics", "Clothing", "Books", "Food")


@query
def timeline_by_category(spark, d):
    """Total sales of each category along a timeline."""
    log = C.changelog(spark, d)
    return rounded(Replay(log, [P.FullRefresh(76)], measures=M.by_value("category", CATEGORIES)).timeline())


@query
def timeline_average_sale(spark, d):
    """Average sale along a timeline: two additive measures and their ratio."""
    measures = {"total_sales": M.sales_amount(), "sales": F.lit(1).cast("bigint")}
    timeline = Replay(C.changelog(spark, d), [P.FullRefresh(76)], measures=measures).timeline()
    return rounded(M.ratio_metric(timeline, "average_sale", "total_sales", "sales", "Average Sale"))


LOADS: dict[str, P.Policy] = {
    "loads_immediate": P.Immediate(),
    "loads_full_refresh": P.FullRefresh(6),
    "loads_periodic_snapshot": P.PeriodicSnapshot(76),
    "loads_hot_window": P.HotWindow(hot=24, every=36, full_every=120),
    "loads_hot_window_fast": P.HotWindow(hot=96, every=24, full_every=240),
    "loads_reconcile": P.LaggedReconcile(every=12, lag=5),
    "loads_window_gate": P.WindowGate(size=6, lateness=12),
    "loads_commit": P.CommitSnapshot(every=8),
}
for _name, _policy in LOADS.items():
    REGISTRY[_name] = _loads(_policy)


@query
def timeline_kept(spark, d):
    """The immediate timeline after three appends in order of the events, whose arrivals overlap by days."""
    log = materialize(C.changelog(spark, d), "log")
    own = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("_ts"))
    log = log.join(own, "event_id")
    kept = KeptTimeline(spark, scratch_path(spark, "kept"))
    edges = [None, "2024-01-10 00:00:00", "2024-01-20 00:00:00", None]
    for number, (lower, upper) in enumerate(zip(edges, edges[1:])):
        part = log if lower is None else log.filter(F.col("_ts") >= F.lit(lower))
        kept.append(part if upper is None else part.filter(F.col("_ts") < F.lit(upper)), number)
    return rounded(kept.read())


@query
def timeline_of_observed_log(spark, d):
    """A refreshed timeline over a log just stored, with the bounds that were observed while it was written."""
    path = scratch_path(spark, "log")
    bounds = sinks.save_log(C.changelog(spark, d), path)
    return rounded(Replay(C.read_log(spark, path), [P.FullRefresh(6)], profile=bounds).timeline())


def sold_item() -> Column:
    return F.concat_ws("/", "product_name", "region_name", F.col("quantity").cast("string"))


@query
def timeline_max_sale(spark, d):
    """The greatest single sale that readers see, at every arrival."""
    measures = {"max_sale": M.Largest(M.sales_amount())}
    return rounded(Replay(C.changelog(spark, d), [P.Immediate()], measures=measures).timeline())


@query
def timeline_sale_range(spark, d):
    """Total, greatest and least sale side by side, behind two policies."""
    measures = {"total_sales": M.sales_amount(), "max_sale": M.Largest(M.sales_amount()), "min_sale": M.Smallest(M.sales_amount())}
    return rounded(Replay(C.changelog(spark, d), [P.FullRefresh(76), P.LaggedReconcile(12, 5)], measures=measures).timeline())


@query
def timeline_distinct_products(spark, d):
    """How many different products (by region and quantity) the served sales have, at every arrival."""
    measures = {"distinct_products": M.DistinctCount(sold_item())}
    return rounded(Replay(C.changelog(spark, d), [P.Immediate()], measures=measures).timeline())


def _calendar(spark, d):
    """Refreshes at the times at which users were last seen; those of every tenth user read everything."""
    events = spark.read.parquet(f"{d}/events.parquet")
    last = events.groupBy("user_id").agg(F.max("ts").alias("at"))
    return last.select(F.col("at").cast("timestamp_ntz").alias("at"), (F.col("user_id") % 10 == 0).alias("full"))


def _refreshed(spark, d):
    """The log, the calendar, the hours that a refresh reads back and the log's size."""
    log = C.changelog(spark, d, [c for c in C.EVENT_COLUMNS if c != "event_time"])
    return log, _calendar(spark, d), 24, log.count()


@query
def calendar_loads(spark, d):
    """How often refreshes at irregular times write each row, and when readers see it first."""
    return calendar.calendar_load_counts(*_refreshed(spark, d))


@query
def calendar_loads_hot_keys(spark, d):
    """The same with a limit at which nearly every key counts as hot."""
    return calendar.calendar_load_counts(*_refreshed(spark, d), hot_rows=1)


@query
def calendar_refreshes(spark, d):
    """What each refresh of the calendar loads."""
    return rounded(calendar.calendar_refresh_totals(*_refreshed(spark, d)))


@query
def rows_loaded(spark, d):
    """Load volume of several policies from one pass over the log."""
    chosen = [P.Immediate(), P.FullRefresh(6), P.HotWindow(24, 36, 120), P.LaggedReconcile(12, 5), P.WindowGate(6, 12)]
    return Replay(C.changelog(spark, d), chosen).rows_loaded()


@query
def row_load_report(spark, d):
    log = C.changelog(spark, d)
    replay = Replay(log, [Run(P.FullRefresh(76), "S4"), Run(P.LaggedReconcile(12, 5), "S4")])
    return reports.replay_load_report(replay, sequence.source_row_number(log, replay.profile.rows))


@query
def served_state(spark, d):
    """Rows a reader of the hot-window policy sees at a time."""
    return Replay(C.changelog(spark, d), [P.HotWindow(24, 36, 120)]).served(at=AT)


@query
def commit_times(spark, d):
    log = C.changelog(spark, d, ["arrival_time"])
    commits = P.CommitSnapshot(8).commits(log, C.profile(log))
    return commits.select(to_timestamp("commit_us").alias("commit_cutoff"))


@query
def committed_snapshot(spark, d):
    log = C.changelog(spark, d)
    return views.committed_snapshot(log, commit_times(spark, d))


@query
def window_finality(spark, d):
    return P.window_finality(C.changelog(spark, d), size=24, lateness=12)


@query
def window_assignment(spark, d):
    """Epoch-aligned windows of a fractional number of hours."""
    gate = P.WindowGate(size=1.5)
    log = C.changelog(spark, d, ["event_id", "event_time"])
    start = gate.window_index(to_micros("event_time")) * hours(gate.size)
    return log.select(
        "event_id", to_timestamp(start).alias("window_start"), to_timestamp(start + hours(gate.size)).alias("window_end")
    )


# -- quality -------------------------------------------------------------------------------------------------

QUALITY_POLICIES = (P.Immediate(), P.FullRefresh(6), P.LaggedReconcile(12, 5))


def _price_history(spark, d):
    """Orders as a value timeline: a group per status, the horizon moves once a month."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderstatus").alias("policy"),
        F.lit("price").alias("metric"),
        F.col("o_orderdate").alias("arrival_time"),
        F.col("o_orderkey").alias("event_count"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 11 != 0, month).alias("max_visible_arrival_time"),
    )


@query
def timeline_normalised(spark, d):
    return Q.normalize_timeline(_price_history(spark, d))


@query
def timeline_coerced(spark, d):
    """Text columns: values that do not parse become null, rows without a time are dropped."""
    text = _price_history(spark, d).select(
        "policy",
        F.when(F.col("event_count") % 7 == 0, "n/a").otherwise(F.col("arrival_time").cast("string")).alias("arrival_time"),
        "event_count",
        F.when(F.col("event_count") % 5 == 0, "?").otherwise(F.col("value").cast("string")).alias("value"),
        F.col("max_visible_arrival_time").cast("string").alias("max_visible_arrival_time"),
    )
    typed = Q.normalize_timeline(text)
    return typed.groupBy("policy").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("values"),
        F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 6).alias("total"),
        F.max("max_visible_arrival_time").alias("horizon"),
    )


@query
def metric_selection(spark, d):
    return Q.metric_rows(_price_history(spark, d), "F", "price")


@query
def restatement(spark, d):
    return rounded(Q.restatement(Q.normalize_timeline(_price_history(spark, d))))


@query
def visibility_aligned(spark, d):
    log = C.changelog(spark, d)
    timeline = Replay(log, [P.FullRefresh(6)]).timeline()
    return Q.align_visibility(views.observation_grid(log), timeline, groups=["full_refresh"])


@query
def freshness(spark, d):
    log = C.changelog(spark, d)
    replay = Replay(log, [P.FullRefresh(76), P.LaggedReconcile(12, 5), P.HotWindow(24, 36, 120)])
    return rounded(Q.replay_freshness(replay))


@query
def freshness_of_timeline(spark, d):
    """The same from a stored timeline and an as-of step, as for a timeline of unknown origin."""
    log = C.changelog(spark, d)
    replay = Replay(log, [P.FullRefresh(76), P.LaggedReconcile(12, 5), P.HotWindow(24, 36, 120)])
    names = [r.policy.name for r in replay.runs]
    timeline = materialize(replay.timeline(), "timeline")
    points = replay.hour_bound + replay.profile.densest_hour
    return rounded(Q.freshness(timeline, views.observation_grid(log), groups=names, rows=points))


@query
def accuracy_live(spark, d):
    return rounded(Q.accuracy(Replay(C.changelog(spark, d), QUALITY_POLICIES), AT))


@query
def accuracy_daily(spark, d):
    return rounded(Q.accuracy(Replay(C.changelog(spark, d), QUALITY_POLICIES), AT, views.daily_window(AT, 8)))


@query
def accuracy_weekly(spark, d):
    return rounded(Q.accuracy(Replay(C.changelog(spark, d), QUALITY_POLICIES), AT, views.weekly_window(AT)))


def _outcomes(spark, d, chosen):
    log = materialize(C.changelog(spark, d), "log")  # read by the profile, by each policy's lookups and by the replay
    replay = Replay(log, [Run(p, t.scenario) for t in Q.TARGETS for p in chosen])
    return Q.evaluate(replay, at=AT), replay


@query
def evaluate(spark, d):
    """All outcome fields; flags and counts that may be missing are given as text and doubles."""
    outcomes = rounded(_outcomes(spark, d, QUALITY_POLICIES)[0])
    optional = {"boolean": "string", "bigint": "double"}
    kept = ("rows_loaded_count", "freshness_unserved_points")
    return outcomes.select(
        *[F.col(n).cast(optional[t]).alias(n) if t in optional and n not in kept else n for n, t in outcomes.dtypes]
    )


@query
def derived_metrics(spark, d):
    outcomes, replay = _outcomes(spark, d, QUALITY_POLICIES)
    derived = Q.derived_metrics(outcomes, replay.profile.rows)
    return rounded(
        derived.select("scenario", "policy", "source_row_count", "write_amplification",
                       *[c for c in derived.columns if "headroom" in c])
    )


@query
def pass_matrix(spark, d):
    outcomes, _ = _outcomes(spark, d, QUALITY_POLICIES)
    return reports.pass_matrix(outcomes, [p.name for p in QUALITY_POLICIES])


SEVEN = (
    P.Immediate(), P.FullRefresh(6), P.HotWindow(24, 36, 120), P.LaggedReconcile(12, 5), P.WindowGate(6, 12),
    P.CommitSnapshot(8), P.PeriodicSnapshot(76),
)


def _study(spark, d):
    """All seven policies under all scenarios, whose targets are read from a stored table."""
    targets = materialize(Q.targets_table(spark), "targets")
    log = materialize(C.changelog(spark, d), "log")
    replay = Replay(log, [Run(p, t.scenario) for t in Q.targets_of(targets) for p in SEVEN])
    return replay, Q.evaluate(replay, targets, at=AT)


def _comparable(outcomes: DataFrame) -> DataFrame:
    """Flags and counts that may be missing as text and doubles."""
    optional = {"boolean": "string", "bigint": "double"}
    kept = ("rows_loaded_count", "freshness_unserved_points")
    return rounded(outcomes).select(
        *[F.col(n).cast(optional[t]).alias(n) if t in optional and n not in kept else n for n, t in outcomes.dtypes]
    )


@query
def evaluate_seven_policies(spark, d):
    return _comparable(_study(spark, d)[1])


@query
def pass_matrix_seven_policies(spark, d):
    return reports.pass_matrix(_study(spark, d)[1], [p.name for p in SEVEN])


@query
def saved_outcomes(spark, d):
    """The outcomes of the study among the stored result tables, read back."""
    replay, outcomes = _study(spark, d)
    loads = reports.replay_load_report(replay, sequence.source_row_number(replay.log, replay.profile.rows))
    root = scratch_path(spark, "results")
    sinks.save_results(root, replay.timeline(), outcomes, loads)
    schema = T.StructType([*outcomes.schema.fields, T.StructField("run_type", T.StringType())])
    return _comparable(sinks.read_csv(spark, f"{root}/outcomes", schema))


@query
def freshness_with_gaps(spark, d):
    """Freshness of a timeline that has no horizon at some of its points, over all order dates."""
    history = materialize(Q.normalize_timeline(_price_history(spark, d)), "history")
    grid = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp_ntz").alias("arrival_time")).distinct()
    return rounded(Q.freshness(history, grid))


SWEEP = (P.FullRefresh(76), P.FullRefresh(6), P.FullRefresh(24))


def _candidates(spark, d):
    """A sweep of one policy's cadence as candidates; the fastest one is only a fallback."""
    outcomes, _ = _outcomes(spark, d, SWEEP)
    outcomes = outcomes.withColumn("params", sinks.params_from_json("policy_params"))
    cadence = reports.cadence_hours()
    return outcomes.withColumns(
        {
            "cadence_hours": cadence,
            "phase": F.when(cadence < 10, 1).otherwise(0),
            "position": F.when(cadence > 50, 0).otherwise(1),
        }
    )


@query
def candidate_pick(spark, d):
    chosen = reports.candidate_pick(_candidates(spark, d))
    return rounded(chosen.select("scenario", "policy", "cadence_hours", "phase", "met_target", "unmet_gap"))


@query
def distinct_candidates(spark, d):
    """Order lines as parameter sets that repeat within a supplier."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_suppkey").alias("scenario"),
        F.col("l_returnflag").alias("policy"),
        F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount")).alias("params"),
        F.col("l_linenumber").alias("phase"),
        F.col("l_orderkey").alias("position"),
    )
    kept = reports.distinct_candidates(lines)
    return kept.select(
        "scenario", "policy", "phase", "position",
        F.col("params")["quantity"].alias("quantity"), F.col("params")["discount"].alias("discount"),
    )


# -- maintenance ---------------------------------------------------------------------------------------------


@query
def full_refresh(spark, d):
    return maintain.full_refresh(C.changelog(spark, d), AT)


@query
def incremental_merge(spark, d):
    log = C.changelog(spark, d)
    return maintain.incremental_merge(views.snapshot_as_of(log, EARLIER), log, EARLIER, AT)


@query
def backfill_partition(spark, d):
    log = C.changelog(spark, d)
    return maintain.backfill_partition(views.snapshot_as_of(log, CUTS[0]), log, EARLIER, AT)


def _keyed_table(spark, state: DataFrame) -> KeyedTable:
    path = scratch_path(spark, "keyed-table")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in C.LOG_SCHEMA.fields)
    table = KeyedTable(spark, f"tidemark_{path.rpartition('-')[2]}", path, ddl)
    table.fill(state)
    return table


@query
def bucketed_merge(spark, d):
    """Two merges into a stored table, each of which rewrites the buckets it touches."""
    log = materialize(C.changelog(spark, d), "log")
    table = _keyed_table(spark, views.snapshot_as_of(log, CUTS[0]))
    table.merge(log, CUTS[0], EARLIER)
    table.merge(log, EARLIER, AT)
    return table.read()


@query
def bucketed_backfill(spark, d):
    log = materialize(C.changelog(spark, d), "log")
    table = _keyed_table(spark, views.snapshot_as_of(log, CUTS[0]))
    table.backfill(log, EARLIER, AT)
    return table.read()


@query
def rows_of_keys(spark, d):
    log = C.changelog(spark, d)
    return maintain.rows_of_keys(log, views.changed_keys(views.increment(log, EARLIER, AT)))


@query
def delete_keys(spark, d):
    log = C.changelog(spark, d)
    return maintain.delete_keys(views.snapshot_as_of(log), views.changed_keys(views.increment(log, EARLIER, AT)))


@query
def append_log(spark, d):
    log = C.changelog(spark, d)
    return maintain.append_log(views.as_of(log, EARLIER), log.filter(F.col("arrival_time") > F.lit(EARLIER).cast("timestamp_ntz")))


@query
def mark_final(spark, d):
    windowed = P.window_finality(C.changelog(spark, d), size=24, lateness=-1)
    return maintain.mark_final(windowed, AT)


# -- streaming -----------------------------------------------------------------------------------------------


@query
def stream_latest_state(spark, d):
    root = scratch_path(spark, "latest")
    landing.replay_in_steps(
        C.changelog(spark, d), CUTS, f"{root}/in",
        lambda: jobs.start_latest_state(jobs.read_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint"),
    )
    return jobs.read_latest_state(spark, f"{root}/table")


@query
def stream_many_files(spark, d):
    """The same state from one micro-batch for each landed file."""
    root = scratch_path(spark, "files")
    landing.replay_in_steps(
        C.changelog(spark, d).repartition(3, "sale_id"), CUTS, f"{root}/in",
        lambda: jobs.start_latest_state(
            jobs.read_stream(spark, f"{root}/in", files_per_trigger=1), f"{root}/table", f"{root}/checkpoint"
        ),
    )
    return jobs.read_latest_state(spark, f"{root}/table")


@query
def stream_dedup(spark, d):
    """Commits over a stream in which many changes of a key share an arrival."""
    root = scratch_path(spark, "dedup")
    landing.replay_in_steps(
        _tied_log(spark, d), CUTS, f"{root}/in",
        lambda: jobs.start_commits(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint", 24),
    )
    return jobs.read_committed(spark, root)


@query
def stream_reconcile(spark, d):
    root = scratch_path(spark, "reconcile")
    landing.replay_in_steps(
        C.changelog(spark, d), CUTS, f"{root}/in",
        lambda: jobs.start_reconcile(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint", 12, 5),
    )
    return jobs.read_reconciled(spark, root)


@query
def stream_commit(spark, d):
    root = scratch_path(spark, "commit")
    landing.replay_in_steps(
        C.changelog(spark, d), CUTS, f"{root}/in",
        lambda: jobs.start_commits(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint", 24),
    )
    return jobs.read_committed(spark, root)


@query
def stream_window_native(spark, d):
    root = scratch_path(spark, "windows")
    landing.replay_in_steps(
        C.changelog(spark, d), CUTS, f"{root}/in",
        lambda: jobs.start_windowed_sales(
            jobs.read_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint", "24 hours", "12 hours"
        ),
    )
    return rounded(jobs.read_windowed_sales(spark, f"{root}/table").drop("batch_id"))


@query
def stream_keyed_state(spark, d):
    """The latest state from the state store, over three runs that each go on where the one before stopped."""
    root = scratch_path(spark, "keyed")
    landing.replay_in_steps(
        C.changelog(spark, d), CUTS, f"{root}/in",
        lambda: keyed.start_keyed_state(jobs.read_stream(spark, f"{root}/in"), f"{root}/checkpoint"),
    )
    return keyed.read_keyed_state(spark, f"{root}/checkpoint")


def _torn_log(spark, d):
    """The tied log in three parts cut within a day, so that rows of one key and arrival are torn apart."""
    log, day = _tied_log(spark, d), F.col("arrival_time")
    cuts = [F.lit(c).cast("timestamp_ntz") for c in CUTS]
    early = [(day < c) | ((day == c) & (F.col("event_id") % 2 == 0)) for c in cuts]
    return [log.filter(early[0]), log.filter(~early[0] & early[1]), log.filter(~early[1])]


@query
def stream_dedup_torn(spark, d):
    """One row for each key and arrival, though ties lie in different micro-batches."""
    root = scratch_path(spark, "torn")
    for part in _torn_log(spark, d):
        landing.land(
            part, f"{root}/in",
            lambda: keyed.start_dedup(jobs.read_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint"),
        )
    return keyed.read_dedup(spark, f"{root}/table", f"{root}/checkpoint")


@query
def stream_window_gate(spark, d):
    """The rows that the exact gate accepts from a stream whose cuts tear arrivals apart."""
    root = scratch_path(spark, "gate")
    for part in _torn_log(spark, d):
        landing.land(
            part, f"{root}/in",
            lambda: gate.start_gate(jobs.read_stream(spark, f"{root}/in"), root, f"{root}/checkpoint", 6, 12),
        )
    return gate.read_gate(spark, root, 6, 12)
