"""The same results as plain SQL on the given tables, worked out another way.

Where the library turns a policy into one visibility time per row, the SQL here replays it: a snapshot for every
refresh, a recursive chain for commits, a running total of per-row differences for the policies seen at each arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

HOUR = 3_600_000_000
AT = "TIMESTAMP '2024-01-25 00:00:00'"
EARLIER = "TIMESTAMP '2024-01-20 00:00:00'"
FIRST_CUT = "TIMESTAMP '2024-01-12 00:00:00'"
AT_US = f"epoch_us({AT})"

# The change log as FIXTURES.md defines it, then the columns that the replays read (times in microseconds).
LOG = """
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), log AS (
  SELECT event_id, user_id * 100 + k AS sale_id,
    MIN(ts) OVER (PARTITION BY user_id * 100 + k) AS event_time,
    ts + to_microseconds(((event_id * 7919) % 86400) * 1000000
      + CASE WHEN event_id % 5 = 0 THEN (event_id % 9 + 1) * 86400000000 ELSE 0 END) AS arrival_time,
    'Product_' || (event_id % 10 + 1) AS product_name,
    CASE event_id % 4 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Clothing' WHEN 2 THEN 'Books' ELSE 'Food' END AS category,
    'Region_' || (user_id % 10 + 1) AS region_name,
    CASE user_id % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'EU' ELSE 'APAC' END AS country,
    CAST(1 + k % 24 AS INTEGER) AS quantity, value AS amount,
    event_type IN ('click', 'view') AS is_update, event_type = 'error' AS is_deleted
  FROM base
), v AS (
  SELECT *, epoch_us(arrival_time) AS a, epoch_us(event_time) AS e,
    CAST(amount AS DECIMAL(18,4)) * quantity AS m
  FROM log
), b AS (SELECT MIN(a) AS t0, MAX(a) AS tn, COUNT(*) AS n FROM v)
"""
EVENT_COLUMNS = (
    "event_id, sale_id, event_time, arrival_time, product_name, category, region_name, country, quantity, amount, "
    "is_update, is_deleted"
)


def with_log(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join([LOG, *ctes]) + " " + body


def latest(source: str, where: str = "TRUE") -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sale_id ORDER BY arrival_time DESC, "
        f"event_id DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1"
    )


def snapshot(source: str, where: str = "TRUE") -> str:
    return f"SELECT * FROM ({latest(source, where)}) WHERE NOT is_deleted"


def ts(us: str) -> str:
    return f"make_timestamp(CAST({us} AS BIGINT))"


TOTAL = "CAST(COALESCE(SUM(m), 0) AS DOUBLE)"
WHOLE_LOG = f"SELECT {EVENT_COLUMNS} FROM log"

# -- replays -------------------------------------------------------------------------------------------------
# A replay defines grid(p, t): observation points, cut(p, t, c): the cutoff a reader sees from time t on.


def grid_points(policy: str, every: float) -> str:
    step = round(every * HOUR)
    return f"SELECT '{policy}' AS p, t, t AS c FROM b, UNNEST(generate_series(t0, tn, {step})) AS g(t)"


def reconcile_cuts(policy: str, every: float, lag: float) -> str:
    """The first arrival of each cadence cell shows the arrivals up to itself minus the lag."""
    step, late = round(every * HOUR), round(lag * HOUR)
    return (
        f"SELECT '{policy}' AS p, MIN(a) AS t, MIN(a) - {late} AS c FROM v, b GROUP BY (a - t0) // {step}"
    )


def commit_chain(every: float) -> str:
    step = round(every * HOUR)
    return (
        f"chain(t) AS (SELECT t0 FROM b UNION ALL "
        f"SELECT (SELECT MIN(a) FROM v WHERE a >= chain.t + {step}) FROM chain "
        f"WHERE EXISTS (SELECT 1 FROM v WHERE a >= chain.t + {step}))"
    )


# Value of a full snapshot at every distinct cutoff.
CUTOFF_VALUES = f"""
snap AS (
  SELECT c, sale_id, m, a, event_id, event_time, is_deleted,
    ROW_NUMBER() OVER (PARTITION BY c, sale_id ORDER BY a DESC, event_id DESC) AS rn
  FROM (SELECT DISTINCT c FROM cut) JOIN v ON a <= c
), state AS (SELECT * FROM snap WHERE rn = 1 AND NOT is_deleted),
vals AS (SELECT c, {TOTAL} AS value FROM (SELECT DISTINCT c FROM cut) LEFT JOIN state USING (c) GROUP BY c)
"""
COUNTS = "counts AS (SELECT a, SUM(COUNT(*)) OVER (ORDER BY a) AS n FROM v GROUP BY a)"


def timeline(body: str) -> str:
    return (
        f"SELECT p AS policy, 'total_sales' AS metric, {ts('t')} AS arrival_time, CAST(n AS BIGINT) AS event_count, "
        f"ROUND(value, 6) AS value, 'Total Sales' AS value_label, {ts('c')} AS max_visible_arrival_time FROM ({body})"
    )


def snapshots_timeline(cut: str) -> str:
    """Policies that serve a full snapshot at each of their own points."""
    body = "SELECT cut.p, cut.t, cut.c, value, n FROM cut JOIN vals USING (c) ASOF JOIN counts ON cut.t >= counts.a"
    return with_log(timeline(body), f"cut AS ({cut})", CUTOFF_VALUES, COUNTS)


def arrivals_timeline(cut: str, *ctes: str, recursive: bool = False) -> str:
    """Policies observed at every arrival whose served state changes at their cuts."""
    body = (
        "SELECT cut.p, counts.a AS t, cut.c, value, n FROM counts ASOF JOIN cut ON counts.a >= cut.t "
        "JOIN vals ON vals.c = cut.c"
    )
    return with_log(timeline(body), *ctes, f"cut AS ({cut})", CUTOFF_VALUES, COUNTS, recursive=recursive)


MOVES = """moves AS (
  SELECT a, (CASE WHEN is_deleted THEN 0 ELSE m END) - COALESCE(LAG(CASE WHEN is_deleted THEN 0 ELSE m END)
    OVER (PARTITION BY sale_id ORDER BY a, event_id), 0) AS d FROM accepted
), totals AS (SELECT a, SUM(SUM(d)) OVER (ORDER BY a) AS total FROM moves GROUP BY a)"""


def sampled_timeline(policy: str, every: float) -> str:
    """The running total of replacements read at each grid point, for cadences too short to rank every snapshot."""
    body = f"""
      SELECT g.p, t, c, n, CAST(total AS DOUBLE) AS value FROM ({grid_points(policy, every)}) AS g
      ASOF JOIN totals ON g.t >= totals.a ASOF JOIN counts ON g.t >= counts.a"""
    return with_log(timeline(body), "accepted AS (SELECT * FROM v)", MOVES, COUNTS)


def differences_timeline(policy: str, accepted: str) -> str:
    """Every accepted change replaces the previous one of its key; the totals of the replacements add up."""
    body = f"""
      SELECT '{policy}' AS p, a AS t, a AS c, n,
        CAST(COALESCE(LAST_VALUE(total IGNORE NULLS) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS value
      FROM counts LEFT JOIN totals USING (a)"""
    return with_log(
        timeline(body),
        f"accepted AS ({accepted})",
        MOVES,
        COUNTS,
    )


def gate(size: float, lateness: float) -> str:
    size_us = round(size * HOUR)
    start = f"e - (e % {size_us} + {size_us}) % {size_us}"
    keep = "TRUE" if lateness < 0 else f"window_end > newest - {round(lateness * HOUR)}"
    return f"""
      SELECT * FROM (
        SELECT *, {start} AS window_start, {start} + {size_us} AS window_end,
          MAX(e) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING) AS newest
        FROM v
      ) WHERE {keep}"""


def hot_entries(hot: float, every: float, full_every: float) -> str:
    """CTEs: per refresh the newest row of each key within the range that the refresh reads."""
    hot_us, step, full_us = (round(x * HOUR) for x in (hot, every, full_every))
    return f"""
    points AS (SELECT t, t0, LAG(t) OVER (ORDER BY t) AS before FROM b, UNNEST(generate_series(t0, tn, {step})) AS g(t)),
    refresh AS (
      SELECT t, CASE WHEN before IS NOT NULL AND (t - t0) // {full_us} > (before - t0) // {full_us} THEN t0
                     ELSE GREATEST(t0, t - {hot_us}) END AS lower FROM points
    ),
    entries AS (
      SELECT * FROM (
        SELECT t, v.*, ROW_NUMBER() OVER (PARTITION BY t, sale_id ORDER BY a DESC, event_id DESC) AS rn
        FROM refresh JOIN v ON a >= lower AND a <= t
      ) WHERE rn = 1
    )"""


# At each refresh a key shows its entry of the newest refresh that read the key.
HOT_STATE = """
    hot_state AS (
      SELECT * FROM (
        SELECT points.t AS shown, entries.*, ROW_NUMBER() OVER (PARTITION BY points.t, sale_id ORDER BY entries.t DESC) AS k
        FROM points JOIN entries ON entries.t <= points.t
      ) WHERE k = 1 AND NOT is_deleted
    )"""


def hot_timeline(hot: float, every: float, full_every: float) -> str:
    body = f"""
      SELECT 'hot_window' AS p, points.t AS t, points.t AS c, n, value FROM
        (SELECT points.t, {TOTAL} AS value FROM points LEFT JOIN hot_state ON hot_state.shown = points.t GROUP BY points.t)
        AS points ASOF JOIN counts ON points.t >= counts.a"""
    return with_log(timeline(body), hot_entries(hot, every, full_every), HOT_STATE, COUNTS)


def loads(policy: str, body: str, *ctes: str, recursive: bool = False) -> str:
    return with_log(
        f"SELECT '{policy}' AS policy, event_id, CAST(COUNT(*) AS BIGINT) AS load_count FROM ({body}) GROUP BY event_id",
        *ctes,
        recursive=recursive,
    )


SNAPSHOT_ROWS = "SELECT event_id FROM state"


def reconcile_rows(every: float, lag: float) -> tuple[str, str]:
    """(rows written, CTE): each row once, and the newest live row of every key an increment touched."""
    cuts = f"steps AS (SELECT c, LAG(c) OVER (ORDER BY c) AS last FROM ({reconcile_cuts('x', every, lag)}))"
    merged = """
      SELECT event_id FROM (
        SELECT event_id, is_deleted, ROW_NUMBER() OVER (PARTITION BY c, sale_id ORDER BY a DESC, event_id DESC) AS rn
        FROM steps JOIN v ON a <= c AND (last IS NULL OR a > last)
      ) WHERE rn = 1 AND NOT is_deleted"""
    return f"SELECT event_id FROM v UNION ALL {merged}", cuts


# -- quality -------------------------------------------------------------------------------------------------


def quality_cuts(full_refresh: Sequence[float] = (6,), reconcile: bool = True, immediate: bool = True) -> str:
    """cut(p, run, t, c) of several policies; an arrival is its own cut for the immediate one."""
    parts = [f"SELECT *, {every} AS cadence FROM ({grid_points('full_refresh', every)})" for every in full_refresh]
    if reconcile:
        parts.append(f"SELECT *, 12 AS cadence FROM ({reconcile_cuts('lagged_reconcile', 12, 5)})")
    if immediate:
        parts.append("SELECT DISTINCT 'immediate' AS p, a AS t, a AS c, 0 AS cadence FROM v")
    return "cut AS (" + " UNION ALL ".join(parts) + ")"


# The state each policy serves at the observation time, and the true one.
SERVED = f"""
seen AS (SELECT p, cadence, MAX(c) AS c FROM cut WHERE t <= {AT_US} GROUP BY p, cadence),
served AS (
  SELECT * FROM (
    SELECT p, cadence, v.*, ROW_NUMBER() OVER (PARTITION BY p, cadence, sale_id ORDER BY a DESC, event_id DESC) AS rn
    FROM seen JOIN v ON a <= c
  ) WHERE rn = 1 AND NOT is_deleted
),
truth AS ({snapshot('v', f'a <= {AT_US}')})
"""


def period(hours: int | None, delay: int = 0) -> str:
    if hours is None:
        return "TRUE"
    end = f"({AT_US} - {delay} * {HOUR})"
    return f"e >= {end} - {hours} * {HOUR} AND e < {end}"


def ratio(truth: str, served: str) -> str:
    return (
        f"CASE WHEN ABS({truth}) <= 1e-6 THEN (CASE WHEN ABS({served}) <= 1e-6 THEN 1.0 ELSE 0.0 END) "
        f"ELSE GREATEST(0.0, 1.0 - ABS({served} - {truth}) / ABS({truth})) END"
    )


def accuracy(where: str) -> str:
    body = f"""
      SELECT p AS policy, truth_value, served_value, ROUND(served_value - truth_value, 6) AS delta,
        ROUND({ratio('truth_value', 'served_value')}, 6) AS ratio, truth_rows
      FROM (SELECT p, (SELECT {TOTAL} FROM truth WHERE {where}) AS truth_value,
              (SELECT COUNT(*) FROM truth WHERE {where}) AS truth_rows,
              (SELECT {TOTAL} FROM served WHERE served.p = seen.p AND {where}) AS served_value FROM seen)"""
    return with_log(body, quality_cuts(), SERVED)


def lag_metrics(grid: str) -> str:
    """CTE lags(p, cadence, lag) over a grid of arrivals and CTE fresh(p, cadence, longest, p95)."""
    return f"""
    lags AS (
      SELECT p, cadence, GREATEST(a - COALESCE(c, t0), 0) / 6e7 AS lag, c IS NULL AS unserved FROM (
        SELECT r.p, r.cadence, r.a, cut.c FROM
          (SELECT * FROM (SELECT DISTINCT p, cadence FROM cut), ({grid})) AS r
          ASOF LEFT JOIN cut ON r.p = cut.p AND r.cadence = cut.cadence AND r.a >= cut.t
      ), b
    ),
    fresh AS (
      SELECT p, cadence, MAX(lag) AS longest, QUANTILE_CONT(lag, 0.95) AS p95,
        COUNT(*) FILTER (unserved) AS unserved FROM lags GROUP BY p, cadence
    )"""


def tied(sql: str) -> str:
    """The same over a log with arrivals cut to the day and event times of their own, one row per key and arrival."""
    rows = """tied AS (
      SELECT * EXCLUDE (newest) FROM (
        SELECT log.* REPLACE (CAST(date_trunc('day', arrival_time) AS TIMESTAMP) AS arrival_time, ts AS event_time),
          ROW_NUMBER() OVER (PARTITION BY sale_id, date_trunc('day', arrival_time) ORDER BY event_id DESC) AS newest
        FROM log JOIN (SELECT event_id, ts FROM events) USING (event_id)
      ) WHERE newest = 1
    ), v AS (SELECT *, epoch_us"""
    out = sql.replace("v AS (\n  SELECT *, epoch_us", rows, 1).replace("FROM log\n), b AS", "FROM tied\n), b AS", 1)
    assert out.count("tied") == 2
    return out


FRESHNESS = with_log(
    """SELECT p AS policy, ROUND(longest, 6) AS freshness_max_minutes, ROUND(p95, 6) AS freshness_p95_minutes,
         unserved AS freshness_unserved_points FROM fresh""",
    f"""cut AS (
      SELECT *, 76 AS cadence FROM ({grid_points('full_refresh', 76)})
      UNION ALL SELECT *, 36 FROM ({grid_points('hot_window', 36)})
      UNION ALL SELECT *, 12 FROM ({reconcile_cuts('lagged_reconcile', 12, 5)}))""",
    lag_metrics("SELECT DISTINCT a FROM v"),
)

TARGETS = """
targets(scenario, f_target, l_target, d_target, d_delay, w_target, w_delay, s_target) AS (VALUES
  ('B0', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('S1', 10.0, 0.60, NULL, NULL, NULL, NULL, NULL),
  ('S2', 60.0, 0.80, NULL, NULL, NULL, NULL, NULL),
  ('S3', 1440.0, NULL, 0.99, 8.0, NULL, NULL, NULL),
  ('S4', 10080.0, NULL, NULL, NULL, 0.999, 0.0, 0.0),
  ('S5', 10.0, 0.80, 0.99, 8.0, 0.999, 0.0, 0.0))
"""


def outcome_ctes(full_refresh: Sequence[float], others: bool) -> list[str]:
    """CTE out: one row per scenario and candidate with observed values and pass flags."""
    grid = f"SELECT DISTINCT a FROM v WHERE a <= {AT_US}"
    totals = ", ".join(
        f"(SELECT {TOTAL} FROM truth WHERE {w}) AS {n}_truth, (SELECT COUNT(*) FROM truth WHERE {w}) AS {n}_rows, "
        f"(SELECT {TOTAL} FROM served WHERE served.p = seen.p AND served.cadence = seen.cadence AND {w}) AS {n}_served"
        for n, w in (("l", period(None)), ("d", period(24, 8)), ("w", period(168)))
    )
    loaded = [
        f"SELECT 'full_refresh' AS p, {every} AS cadence, (SELECT COUNT(*) FROM g{i} JOIN h ON h.a <= g{i}.t AND "
        f"(h.next IS NULL OR h.next > g{i}.t) WHERE NOT is_deleted) AS loaded"
        for i, every in enumerate(full_refresh)
    ]
    ctes = [f"g{i} AS ({grid_points('x', every)})" for i, every in enumerate(full_refresh)]
    ctes.append("h AS (SELECT *, LEAD(a) OVER (PARTITION BY sale_id ORDER BY a, event_id) AS next FROM v)")
    if others:
        rows, steps = reconcile_rows(12, 5)
        ctes.append(steps)
        loaded.append(f"SELECT 'lagged_reconcile', 12, (SELECT COUNT(*) FROM ({rows}))")
        loaded.append("SELECT 'immediate', 0, (SELECT COUNT(*) FROM v)")
    transitions = """still AS (
      SELECT p, cadence, COUNT(*) AS transitions FROM (
        SELECT r.p, r.cadence, r.a, cut.c, LAG(cut.c) OVER (PARTITION BY r.p, r.cadence ORDER BY r.a) AS before FROM
          (SELECT 'lagged_reconcile' AS p, 12 AS cadence, a FROM (%s)) AS r
          ASOF JOIN cut ON r.p = cut.p AND r.cadence = cut.cadence AND r.a >= cut.t
      ) WHERE c = before GROUP BY p, cadence)""" % grid
    return [
        quality_cuts(full_refresh, others, others),
        SERVED,
        lag_metrics(grid),
        *ctes,
        f"loaded AS ({' UNION ALL '.join(loaded)})",
        TARGETS,
        transitions,
        f"""out AS (
          SELECT *, {ratio('l_truth', 'l_served')} AS l_ratio, {ratio('d_truth', 'd_served')} AS d_ratio,
            {ratio('w_truth', 'w_served')} AS w_ratio, longest <= f_target + 1e-3 AS f_pass
          FROM targets, (SELECT p, cadence, {totals} FROM seen)
          JOIN fresh USING (p, cadence) JOIN loaded USING (p, cadence) LEFT JOIN still USING (p, cadence))""",
    ]


TRUE_TEXT = "'true'"


def _when(target: str, value: str) -> str:
    return f"CASE WHEN {target} IS NOT NULL THEN {value} END"


def _window(n: str, name: str, hours: int, delay: int) -> str:
    t, end = f"{n}_target", f"({AT_US} - {delay} * {HOUR})"
    return f"""
      {t} AS {name}_accuracy_target_ratio, {n}_delay AS {name}_accuracy_delay_hours,
      {_when(t, ts(f'{end} - {hours} * {HOUR}'))} AS {name}_start, {_when(t, ts(end))} AS {name}_end,
      {_when(t, f'CAST({n}_rows AS DOUBLE)')} AS {name}_truth_rows, {_when(t, f'{n}_truth')} AS {name}_truth_value,
      {_when(t, f'{n}_served')} AS {name}_served_value, {_when(t, f'ROUND({n}_served - {n}_truth, 6)')} AS {name}_delta,
      {_when(t, f'ROUND({n}_ratio, 6)')} AS {name}_accuracy_ratio,
      CAST({n}_ratio + 1e-6 >= {t} AS VARCHAR) AS {name}_accuracy_pass"""


def outcome_query(params: str, still: Sequence[str], *ctes: str, recursive: bool = False) -> str:
    """All outcome fields; ``still``: revisions, their ratio, sum and greatest as SQL."""
    revisions, share, total, most = still
    return with_log(
        f"""
    SELECT scenario, p AS policy, {params} AS policy_params,
      loaded AS rows_loaded_count, CAST(f_target AS DOUBLE) AS freshness_target_minutes,
      ROUND(longest, 6) AS freshness_max_minutes, ROUND(p95, 6) AS freshness_p95_minutes,
      unserved AS freshness_unserved_points, CAST(f_pass AS VARCHAR) AS freshness_pass,
      CAST(l_target AS DOUBLE) AS live_accuracy_target_ratio, {_when('l_target', 'l_truth')} AS live_accuracy_truth_value,
      {_when('l_target', 'l_served')} AS live_accuracy_served_value,
      {_when('l_target', 'ROUND(l_served - l_truth, 6)')} AS live_accuracy_delta,
      {_when('l_target', 'ROUND(l_ratio, 6)')} AS live_accuracy_ratio,
      CAST(l_ratio + 1e-6 >= l_target AS VARCHAR) AS live_accuracy_pass,
      {_window('d', 'daily_window', 24, 8)}, {_window('w', 'weekly_window', 168, 0)},
      CAST(s_target AS DOUBLE) AS stability_target_revision_ratio,
      {_when('s_target', 'CAST(COALESCE(transitions, 0) AS DOUBLE)')} AS stability_same_horizon_transitions,
      {_when('s_target', revisions)} AS stability_revision_count,
      {_when('s_target', share)} AS stability_revision_ratio,
      {_when('s_target', f"CAST({share} <= s_target + 1e-9 AS VARCHAR)")} AS stability_pass,
      {_when('s_target', TRUE_TEXT)} AS stability_evaluable, {_when('s_target', total)} AS stability_total_abs_change,
      {_when('s_target', most)} AS stability_max_abs_change, {AT} AS observation_time
    FROM out""",
        *ctes,
        recursive=recursive,
    )


EVALUATE = outcome_query(
    """CASE p WHEN 'immediate' THEN '{}' WHEN 'full_refresh' THEN '{"every":6.0}' ELSE '{"every":12.0,"lag":5.0}' END""",
    ("0.0", "0.0", "0.0", "0.0"),
    *outcome_ctes((6,), True),
)

DERIVED = with_log(
    f"""
    SELECT scenario, p AS policy, n AS source_row_count, ROUND(loaded / n, 6) AS write_amplification,
      ROUND(f_target - longest, 6) AS freshness_headroom_minutes,
      {_when('l_target', 'ROUND(l_ratio - l_target, 6)')} AS live_accuracy_headroom_ratio,
      {_when('d_target', 'ROUND(d_ratio - d_target, 6)')} AS daily_window_accuracy_headroom_ratio,
      {_when('w_target', 'ROUND(w_ratio - w_target, 6)')} AS weekly_window_accuracy_headroom_ratio,
      CAST(s_target AS DOUBLE) AS stability_headroom_ratio
    FROM out, b""",
    *outcome_ctes((6,), True),
)

MET = """COALESCE(f_pass, TRUE) AND COALESCE(l_ratio + 1e-6 >= l_target, TRUE)
  AND COALESCE(d_ratio + 1e-6 >= d_target, TRUE) AND COALESCE(w_ratio + 1e-6 >= w_target, TRUE)"""

PASS_MATRIX = with_log(
    f"""SELECT scenario, {', '.join(
        f"MAX(CASE WHEN p = '{p}' THEN (CASE WHEN {MET} THEN 'PASS' ELSE 'FAIL' END) END) AS {p}"
        for p in ('immediate', 'full_refresh', 'lagged_reconcile'))}
    FROM out GROUP BY scenario""",
    *outcome_ctes((6,), True),
)



def _miss(target: str, difference: str) -> str:
    return f"CASE WHEN {target} IS NULL THEN 0 ELSE GREATEST(0, {difference}) END"


# Try the base cadences from slow to fast, then the fallback; without a pass take the smallest gap.
CANDIDATE_PICK = with_log(
    f"""
    SELECT scenario, p AS policy, CAST(cadence AS DOUBLE) AS cadence_hours, phase, met AS met_target,
      ROUND(gap, 6) AS unmet_gap
    FROM (
      SELECT *, ROW_NUMBER() OVER (
        PARTITION BY scenario ORDER BY met DESC, CASE WHEN met THEN turn END, gap, turn) AS rn
      FROM (
        SELECT *, CASE cadence WHEN 76 THEN 1 WHEN 24 THEN 2 ELSE 3 END AS turn,
          CASE WHEN cadence < 10 THEN 1 ELSE 0 END AS phase, {MET} AS met,
          {_miss('f_target', 'longest - f_target')} + {_miss('l_target', 'l_target - l_ratio')}
          + {_miss('d_target', 'd_target - d_ratio')} + {_miss('w_target', 'w_target - w_ratio')} AS gap
        FROM out
      )
    ) WHERE rn = 1""",
    *outcome_ctes((76, 6, 24), False),
)

# -- an order history as a timeline --------------------------------------------------------------------------

HISTORY = """
history AS (
  SELECT o_orderstatus AS policy, 'price' AS metric, o_orderdate AS arrival_time, o_orderkey AS event_count,
    o_totalprice AS value,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS max_visible_arrival_time
  FROM orders
)"""
NORMALISED = """
normalised AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY policy, arrival_time ORDER BY event_count DESC) AS rn FROM history
  ) WHERE rn = 1
)"""
RESTATEMENT = f"""
WITH {HISTORY}, {NORMALISED}, steps AS (
  SELECT policy, ABS(value - LAG(value) OVER w) AS change,
    COALESCE(max_visible_arrival_time = LAG(max_visible_arrival_time) OVER w, FALSE) AS same
  FROM normalised WINDOW w AS (PARTITION BY policy ORDER BY arrival_time)
)
SELECT policy, COUNT(*) FILTER (same) AS stability_same_horizon_transitions,
  COUNT(*) FILTER (same AND change > 1e-6) AS stability_revision_count,
  ROUND(CAST(COALESCE(SUM(CAST(change AS DECIMAL(28,6))) FILTER (same AND change > 1e-6), 0) AS DOUBLE), 6)
    AS stability_total_abs_change,
  ROUND(COALESCE(MAX(change) FILTER (same AND change > 1e-6), 0), 6) AS stability_max_abs_change,
  ROUND(CASE WHEN COUNT(*) FILTER (same) > 0
    THEN COUNT(*) FILTER (same AND change > 1e-6) / COUNT(*) FILTER (same) ELSE 0 END, 6) AS stability_revision_ratio
FROM steps GROUP BY policy
"""

# -- event-time windows of the streaming job -----------------------------------------------------------------

DAY = 24 * HOUR
STREAM_WINDOWS = with_log(
    f"""
    SELECT {ts('w')} AS window_start, {ts(f'w + {DAY}')} AS window_end,
      ROUND(CAST(COALESCE(SUM(m) FILTER (NOT is_deleted), 0) AS DOUBLE), 6) AS total_sales,
      COUNT(*) FILTER (NOT is_deleted) AS active_row_count
    FROM taken, (SELECT MAX(e) - 12 * {HOUR} AS mark FROM v) WHERE w + {DAY} <= mark GROUP BY w""",
    f"""steps AS (
      SELECT *, e - e % {DAY} AS w,
        CASE WHEN arrival_time <= {FIRST_CUT} THEN 0 WHEN arrival_time <= {AT} THEN 1 ELSE 2 END AS step FROM v)""",
    f"""marks AS (
      SELECT s.step, (SELECT MAX(e) FROM steps WHERE steps.step < s.step) - 12 * {HOUR} AS mark
      FROM (SELECT DISTINCT step FROM steps) AS s)""",
    f"taken AS (SELECT steps.* FROM steps JOIN marks USING (step) WHERE mark IS NULL OR w + {DAY} > mark)",
)

FIRST_SEEN_HOUR = """hourly AS (
  SELECT country, CAST(date_trunc('hour', arrival_time) AS TIMESTAMP) AS hour, MAX(event_id) AS newest FROM log GROUP BY ALL)"""

_RECONCILE_ROWS, _RECONCILE_STEPS = reconcile_rows(12, 5)
_RECONCILED = with_log(
    f"SELECT {EVENT_COLUMNS} FROM ({snapshot('v', 'a <= (SELECT MAX(c) FROM cut)')})",
    f"cut AS ({reconcile_cuts('x', 12, 5)})",
)
_CHAINED = f"SELECT {EVENT_COLUMNS} FROM ({snapshot('v', 'a <= (SELECT MAX(t) FROM chain)')})"
_TIED_DAY = "CAST(date_trunc('day', arrival_time) AS TIMESTAMP)"
_IMMEDIATE = differences_timeline("immediate", "SELECT * FROM v")

_BY_SNAPSHOT = f"""
      SELECT cut.p, metric, cut.t, cut.c, value, n FROM cut JOIN per USING (c) ASOF JOIN counts ON cut.t >= counts.a"""


def _metrics_timeline(per: str, label: str) -> str:
    """A timeline over full snapshots from a CTE per(c, metric, value)."""
    body = timeline(_BY_SNAPSHOT).replace("'total_sales' AS metric", "metric").replace("'Total Sales'", label)
    return with_log(body, f"cut AS ({grid_points('full_refresh', 76)})", CUTOFF_VALUES, f"per AS ({per})", COUNTS)


ORACLES: dict[str, str] = {
    "changelog": with_log(WHOLE_LOG),
    "source_profile": with_log(
        "SELECT COUNT(*) AS total_events, MIN(event_time) AS min_event_time, MAX(event_time) AS max_event_time FROM log"
    ),
    "arrival_bounds": with_log(
        "SELECT MIN(arrival_time) AS min_arrival_time, MAX(arrival_time) AS max_arrival_time FROM log"
    ),
    # Numbering the rows of an hour from zero is the bump itself, as no hour reaches into the next.
    "unique_arrivals": with_log(
        "SELECT event_id, sale_id, h + to_microseconds(ROW_NUMBER() OVER (PARTITION BY h ORDER BY event_id) - 1) "
        "AS arrival_time FROM (SELECT *, CAST(date_trunc('hour', arrival_time) AS TIMESTAMP) AS h FROM log)"
    ),
    "stored_log_as_of": with_log(f"{WHOLE_LOG} WHERE arrival_time <= {AT}"),
    "stored_log_increment": with_log(f"{WHOLE_LOG} WHERE arrival_time > {EARLIER} AND arrival_time <= {AT}"),
    "saved_results": with_log(
        """SELECT 'S4' AS scenario, 'full_refresh' AS policy, event_id, source_row_number, COUNT(*) AS load_count,
          'scenarios' AS run_type
        FROM state JOIN (SELECT event_id, ROW_NUMBER() OVER (ORDER BY a, event_id) AS source_row_number FROM v)
          USING (event_id) GROUP BY ALL""",
        f"cut AS ({grid_points('x', 76)})",
        CUTOFF_VALUES,
    ),
    "csv_export": with_log(WHOLE_LOG),
    "registered_relation": with_log(
        "SELECT country, COUNT(*) AS changes, COUNT(*) FILTER (is_deleted) AS deletes FROM log GROUP BY country"
    ),
    "parameter_json": """SELECT o_orderkey, '{"customer":' || CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) || ',"total":'
          || CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR) || '}' AS json, o_totalprice AS total,
        CAST(o_custkey AS DOUBLE) AS customer FROM orders""",
    "snapshot_as_of": with_log(f"SELECT {EVENT_COLUMNS} FROM ({snapshot('log', f'arrival_time <= {AT}')})"),
    "latest_rows": with_log(f"SELECT {EVENT_COLUMNS} FROM ({latest('log')})"),
    "total_sales_live": with_log(
        f"SELECT ROUND({TOTAL}, 6) AS total_sales, COUNT(*) AS event_count FROM ({snapshot('v')})"
    ),
    "captured_measures": with_log(
        f"SELECT 'total_sales' AS metric, ROUND({TOTAL}, 6) AS value, 'Total Sales' AS value_label "
        f"FROM ({snapshot('v', f'arrival_time <= {AT}')})"
    ),
    "summarized_measure": with_log(
        f"""SELECT 'revenue_by_country' AS metric, ROUND(AVG(r), 6) AS value, 'revenue' AS value_label FROM
        (SELECT country, CAST(SUM(m) AS DOUBLE) AS r FROM ({snapshot('v', f'arrival_time <= {AT}')}) GROUP BY country)"""
    ),
    "max_visible_arrival": with_log(
        f"SELECT MAX(arrival_time) AS max_visible_arrival_time FROM ({snapshot('log', f'arrival_time <= {AT}')})"
    ),
    "observed_log": with_log(
        f"SELECT {EVENT_COLUMNS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sale_id, arrival_time "
        f"ORDER BY event_id DESC) AS rn FROM (SELECT * REPLACE ({_TIED_DAY} AS arrival_time) FROM log)) WHERE rn = 1"
    ),
    "observation_grid": with_log(f"SELECT DISTINCT arrival_time FROM log WHERE arrival_time <= {AT}"),
    "increment": with_log(f"{WHOLE_LOG} WHERE arrival_time > {EARLIER} AND arrival_time <= {AT}"),
    "arrived_between": with_log(f"{WHOLE_LOG} WHERE arrival_time BETWEEN {EARLIER} AND {AT}"),
    "changed_keys": with_log(
        f"SELECT DISTINCT sale_id FROM log WHERE arrival_time > {EARLIER} AND arrival_time <= {AT}"
    ),
    "truth_total_as_of": with_log(
        f"SELECT ROUND({TOTAL}, 6) AS total_sales FROM ({snapshot('v', f'arrival_time <= {AT}')})"
    ),
    **{
        name: with_log(
            f"SELECT ROUND({TOTAL}, 6) AS total_sales, COUNT(*) AS active_row_count "
            f"FROM ({snapshot('v', f'arrival_time <= {AT}')}) WHERE {where}"
        )
        for name, where in (("truth_daily", period(24, 8)), ("truth_weekly", period(168)))
    },
    "source_row_number": with_log(
        "SELECT event_id, ROW_NUMBER() OVER (ORDER BY arrival_time, event_id) AS source_row_number FROM log"
    ),
    "source_row_number_tied": with_log(
        f"SELECT event_id, ROW_NUMBER() OVER (ORDER BY {_TIED_DAY}, event_id) AS source_row_number FROM log"
    ),
    "running_event_count": with_log(
        "SELECT arrival_time, CAST(SUM(COUNT(*)) OVER (ORDER BY arrival_time) AS BIGINT) AS event_count "
        "FROM log GROUP BY arrival_time"
    ),
    "row_watermark": with_log(
        "SELECT arrival_time, MAX(MAX(event_time)) OVER (ORDER BY arrival_time) AS max_event_time "
        "FROM log GROUP BY arrival_time"
    ),
    "asof_backward": with_log(
        "SELECT event_id, arrival_time, log.country, newest FROM log ASOF LEFT JOIN hourly "
        "ON log.country = hourly.country AND log.arrival_time >= hourly.hour",
        FIRST_SEEN_HOUR,
    ),
    "asof_forward": with_log(
        "SELECT event_id, arrival_time, log.country, COALESCE(newest, -1) AS newest FROM log ASOF LEFT JOIN hourly "
        "ON log.country = hourly.country AND log.arrival_time <= hourly.hour",
        FIRST_SEEN_HOUR,
    ),
    "timeline_immediate": _IMMEDIATE,
    "timeline_immediate_hot_keys": _IMMEDIATE,
    "timeline_full_refresh": snapshots_timeline(grid_points("full_refresh", 6)),
    "timeline_full_refresh_10min": sampled_timeline("full_refresh", 0.166667),
    "timeline_periodic_snapshot": snapshots_timeline(grid_points("periodic_snapshot", 76)),
    "timeline_hot_window": hot_timeline(24, 36, 120),
    "timeline_hot_window_hot_keys": hot_timeline(24, 36, 120),
    "timeline_hot_window_fast": hot_timeline(96, 24, 240),
    "timeline_reconcile": arrivals_timeline(reconcile_cuts("lagged_reconcile", 12, 5)),
    "timeline_reconcile_hourly": arrivals_timeline(reconcile_cuts("lagged_reconcile", 1, 0)),
    "timeline_window_gate": differences_timeline("window_gate", gate(6, 12)),
    "timeline_window_gate_wide": differences_timeline("window_gate", gate(228, 114)),
    "timeline_window_gate_open": differences_timeline("window_gate", gate(6, -1)),
    "timeline_commit": arrivals_timeline(
        "SELECT 'commit_snapshot' AS p, t, t AS c FROM chain", commit_chain(8), recursive=True
    ),
    "timeline_commit_always": differences_timeline("commit_snapshot", "SELECT * FROM v"),
    "timeline_by_category": _metrics_timeline(
        f"""SELECT k.c, 'total_sales:' || k.category AS metric, {TOTAL} AS value
        FROM (SELECT DISTINCT cut.c, x.category FROM cut, (SELECT DISTINCT category FROM log) AS x) AS k
        LEFT JOIN (SELECT state.*, category FROM state JOIN (SELECT event_id, category FROM log) USING (event_id)) AS s
          ON s.c = k.c AND s.category = k.category GROUP BY ALL""",
        "metric",
    ),
    "timeline_average_sale": _metrics_timeline(
        """SELECT c, 'average_sale' AS metric, CAST(SUM(m) AS DOUBLE) / NULLIF(COUNT(state.event_id), 0) AS value
        FROM (SELECT DISTINCT c FROM cut) LEFT JOIN state USING (c) GROUP BY c""",
        "'Average Sale'",
    ),
    "loads_immediate": loads("immediate", "SELECT event_id FROM v"),
    "loads_full_refresh": loads("full_refresh", SNAPSHOT_ROWS, f"cut AS ({grid_points('x', 6)})", CUTOFF_VALUES),
    "loads_periodic_snapshot": loads(
        "periodic_snapshot", SNAPSHOT_ROWS, f"cut AS ({grid_points('x', 76)})", CUTOFF_VALUES
    ),
    "loads_hot_window": loads(
        "hot_window", "SELECT event_id FROM entries WHERE NOT is_deleted", hot_entries(24, 36, 120)
    ),
    "loads_hot_window_fast": loads(
        "hot_window", "SELECT event_id FROM entries WHERE NOT is_deleted", hot_entries(96, 24, 240)
    ),
    "loads_reconcile": loads("lagged_reconcile", _RECONCILE_ROWS, _RECONCILE_STEPS),
    "loads_window_gate": loads("window_gate", f"SELECT event_id FROM ({gate(6, 12)})"),
    "loads_commit": loads("commit_snapshot", "SELECT event_id FROM v"),
    "rows_loaded": with_log(
        f"""SELECT 'immediate' AS policy, n AS rows_loaded_count FROM b
        UNION ALL SELECT 'full_refresh', COUNT(*) FROM state
        UNION ALL SELECT 'hot_window', COUNT(*) FROM entries WHERE NOT is_deleted
        UNION ALL SELECT 'lagged_reconcile', COUNT(*) FROM ({_RECONCILE_ROWS})
        UNION ALL SELECT 'window_gate', COUNT(*) FROM ({gate(6, 12)})""",
        f"cut AS ({grid_points('x', 6)})",
        CUTOFF_VALUES,
        hot_entries(24, 36, 120),
        _RECONCILE_STEPS,
    ),
    "row_load_report": with_log(
        f"""SELECT 'S4' AS scenario, policy, event_id, source_row_number, COUNT(*) AS load_count FROM (
          SELECT 'full_refresh' AS policy, event_id FROM state
          UNION ALL SELECT 'lagged_reconcile', event_id FROM ({_RECONCILE_ROWS})
        ) JOIN (SELECT event_id, ROW_NUMBER() OVER (ORDER BY a, event_id) AS source_row_number FROM v) USING (event_id)
        GROUP BY ALL""",
        f"cut AS ({grid_points('x', 76)})",
        CUTOFF_VALUES,
        _RECONCILE_STEPS,
    ),
    "served_state": with_log(
        f"SELECT {EVENT_COLUMNS} FROM hot_state WHERE shown = (SELECT MAX(t) FROM points WHERE t <= {AT_US})",
        hot_entries(24, 36, 120),
        HOT_STATE,
    ),
    "commit_times": with_log(f"SELECT {ts('t')} AS commit_cutoff FROM chain", commit_chain(8), recursive=True),
    "committed_snapshot": with_log(_CHAINED, commit_chain(8), recursive=True),
    "window_finality": with_log(
        f"""SELECT event_id, sale_id, event_time, arrival_time, {ts('window_start')} AS window_start,
          {ts('window_end')} AS window_end, window_end <= (SELECT MAX(e) FROM v) - 12 * {HOUR} AS is_final
        FROM ({gate(24, 12)})"""
    ),
    "window_assignment": with_log(
        f"SELECT event_id, {ts('window_start')} AS window_start, {ts('window_end')} AS window_end FROM ({gate(1.5, -1)})"
    ),
    "timeline_normalised": f"WITH {HISTORY}, {NORMALISED} SELECT * FROM normalised",
    "timeline_coerced": f"""WITH {HISTORY} SELECT policy, COUNT(*) AS rows, COUNT(v) AS values,
        ROUND(CAST(SUM(CAST(v AS DECIMAL(18,4))) AS DOUBLE), 6) AS total, MAX(max_visible_arrival_time) AS horizon FROM (
          SELECT policy, CASE WHEN event_count % 5 <> 0 THEN value END AS v, max_visible_arrival_time,
            ROW_NUMBER() OVER (PARTITION BY policy, arrival_time ORDER BY event_count DESC) AS rn
          FROM history WHERE event_count % 7 <> 0
        ) WHERE rn = 1 GROUP BY policy""",
    "metric_selection": f"WITH {HISTORY} SELECT * FROM history WHERE policy = 'F'",
    "restatement": RESTATEMENT,
    "visibility_aligned": with_log(
        f"""SELECT 'full_refresh' AS policy, {ts('g.a')} AS arrival_time, {ts('cut.c')} AS max_visible_arrival_time
        FROM (SELECT DISTINCT a FROM v) AS g ASOF JOIN cut ON g.a >= cut.t""",
        f"cut AS ({grid_points('x', 6)})",
    ),
    "freshness": FRESHNESS,
    "freshness_of_timeline": FRESHNESS,
    "accuracy_live": accuracy(period(None)),
    "accuracy_daily": accuracy(period(24, 8)),
    "accuracy_weekly": accuracy(period(168)),
    "evaluate": EVALUATE,
    "derived_metrics": DERIVED,
    "pass_matrix": PASS_MATRIX,
    "candidate_pick": CANDIDATE_PICK,
    "distinct_candidates": """
        SELECT scenario, policy, phase, position, quantity, discount FROM (
          SELECT l_suppkey AS scenario, l_returnflag AS policy, l_linenumber AS phase, l_orderkey AS position,
            l_quantity AS quantity, l_discount AS discount,
            ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_returnflag, l_quantity, l_discount
              ORDER BY l_linenumber, l_orderkey) AS rn FROM lineitem
        ) WHERE rn = 1""",
    "full_refresh": with_log(f"SELECT {EVENT_COLUMNS} FROM ({snapshot('log', f'arrival_time <= {AT}')})"),
    "incremental_merge": with_log(f"SELECT {EVENT_COLUMNS} FROM ({snapshot('log', f'arrival_time <= {AT}')})"),
    "backfill_partition": with_log(
        f"""SELECT {EVENT_COLUMNS} FROM (
          SELECT * FROM ({snapshot('log', f'arrival_time <= {FIRST_CUT}')})
            WHERE sale_id NOT IN (SELECT sale_id FROM log WHERE arrival_time BETWEEN {EARLIER} AND {AT})
          UNION ALL SELECT * FROM ({snapshot('log', f'arrival_time BETWEEN {EARLIER} AND {AT}')}))"""
    ),
    "rows_of_keys": with_log(
        f"{WHOLE_LOG} WHERE sale_id IN "
        f"(SELECT sale_id FROM log WHERE arrival_time > {EARLIER} AND arrival_time <= {AT})"
    ),
    "delete_keys": with_log(
        f"SELECT {EVENT_COLUMNS} FROM ({snapshot('log')}) WHERE sale_id NOT IN "
        f"(SELECT sale_id FROM log WHERE arrival_time > {EARLIER} AND arrival_time <= {AT})"
    ),
    "append_log": with_log(WHOLE_LOG),
    "mark_final": with_log(
        f"""SELECT event_id, sale_id, event_time, arrival_time, {ts('window_start')} AS window_start,
          {ts('window_end')} AS window_end, window_end <= {AT_US} AS is_final FROM ({gate(24, -1)})"""
    ),
    "stream_latest_state": with_log(f"SELECT {EVENT_COLUMNS} FROM ({snapshot('log')})"),
    "stream_reconcile": _RECONCILED,
    "stream_commit": with_log(_CHAINED, commit_chain(24), recursive=True),
    "stream_window_native": STREAM_WINDOWS,
}

ORACLES["saved_snapshots"] = (
    f"SELECT 'S4' AS scenario, *, 'scenarios' AS run_type FROM ({snapshots_timeline(grid_points('full_refresh', 76))})"
)
ORACLES["stream_many_files"] = ORACLES["stream_latest_state"]
ORACLES["stream_dedup"] = tied(ORACLES["stream_commit"])
for _name in ("window_gate", "reconcile", "commit"):
    ORACLES[f"timeline_{_name}_tied"] = tied(ORACLES[f"timeline_{_name}"])
    ORACLES[f"timeline_{_name}_hot_keys"] = ORACLES[f"timeline_{_name}_tied"]
    ORACLES[f"loads_{_name}_hot_keys"] = tied(ORACLES[f"loads_{_name}"])


# -- measures that rows cannot be subtracted from ------------------------------------------------------------


def living_timeline(metric: str, label: str, value: str) -> str:
    """A value of all rows that are the newest of their key and live, looked up anew at every arrival."""
    return with_log(
        f"""SELECT 'immediate' AS policy, '{metric}' AS metric, {ts('a')} AS arrival_time, CAST(n AS BIGINT) AS event_count,
          ROUND(value, 6) AS value, '{label}' AS value_label, {ts('a')} AS max_visible_arrival_time
        FROM (
          SELECT counts.a, ANY_VALUE(n) AS n, CAST({value} AS DOUBLE) AS value
          FROM counts LEFT JOIN life ON life.a <= counts.a AND life.gone > counts.a AND NOT life.is_deleted GROUP BY counts.a
        ) WHERE value IS NOT NULL""",
        "life AS (SELECT *, LEAD(a, 1, 9223372036854775807) OVER (PARTITION BY sale_id ORDER BY a, event_id) AS gone FROM v)",
        COUNTS,
    )


ORACLES["timeline_max_sale"] = living_timeline("max_sale", "Largest", "MAX(life.m)")
ORACLES["timeline_distinct_products"] = living_timeline(
    "distinct_products", "Distinct Count", "COUNT(DISTINCT product_name || '/' || region_name || '/' || quantity)"
)
ORACLES["timeline_sale_range"] = with_log(
    f"""SELECT p AS policy, metric, {ts('t')} AS arrival_time, CAST(n AS BIGINT) AS event_count, ROUND(value, 6) AS value,
      value_label, {ts('c')} AS max_visible_arrival_time
    FROM (
      SELECT p, t, c, n FROM refreshed ASOF JOIN counts ON refreshed.t >= counts.a
      UNION ALL SELECT p, a, c, n FROM counts ASOF JOIN reconciled ON counts.a >= reconciled.t
    ) JOIN metrics USING (c) WHERE value IS NOT NULL""",
    f"refreshed AS ({grid_points('full_refresh', 76)})",
    f"reconciled AS ({reconcile_cuts('lagged_reconcile', 12, 5)})",
    "cut AS (SELECT * FROM refreshed UNION ALL SELECT * FROM reconciled)",
    CUTOFF_VALUES,
    f"""metrics AS (
      SELECT c, 'total_sales' AS metric, value, 'Total Sales' AS value_label FROM vals
      UNION ALL SELECT c, 'max_sale', CAST(MAX(m) AS DOUBLE), 'Largest' FROM state GROUP BY c
      UNION ALL SELECT c, 'min_sale', CAST(MIN(m) AS DOUBLE), 'Smallest' FROM state GROUP BY c
    )""",
    COUNTS,
)

# -- streams -------------------------------------------------------------------------------------------------

ORACLES["stream_keyed_state"] = ORACLES["stream_latest_state"]
ORACLES["stream_dedup_torn"] = tied(with_log(f"SELECT {EVENT_COLUMNS} FROM v"))
ORACLES["stream_window_gate"] = tied(with_log(f"SELECT {EVENT_COLUMNS} FROM ({gate(6, 12)})"))

# -- stored states, merges, calendars ------------------------------------------------------------------------

ORACLES["snapshot_from_stored"] = ORACLES["snapshot_as_of"]
ORACLES["bucketed_merge"] = ORACLES["incremental_merge"]
ORACLES["bucketed_backfill"] = ORACLES["backfill_partition"]

# Each refresh ranks what it reads.
_CALENDAR = f"""
refreshes AS (SELECT seen, epoch_us(seen) AS t, BOOL_OR(user_id % 10 = 0) AS whole
  FROM (SELECT user_id, MAX(ts) AS seen FROM events GROUP BY user_id) GROUP BY seen),
loaded AS (
  SELECT * FROM (
    SELECT seen, event_id, m, is_deleted, ROW_NUMBER() OVER (PARTITION BY seen, sale_id ORDER BY a DESC, event_id DESC) AS rn
    FROM refreshes JOIN v ON a <= t AND (whole OR a >= t - 24 * {HOUR})
  ) WHERE rn = 1 AND NOT is_deleted
)"""
ORACLES["calendar_loads"] = with_log(
    "SELECT event_id, COUNT(*) AS load_count, MIN(seen) AS first_loaded FROM loaded GROUP BY event_id", _CALENDAR
)
ORACLES["calendar_loads_hot_keys"] = ORACLES["calendar_loads"]
ORACLES["calendar_refreshes"] = with_log(
    "SELECT seen AS \"at\", COUNT(event_id) AS loaded_rows, ROUND(CAST(COALESCE(SUM(m), 0) AS DOUBLE), 6) AS loaded_sales "
    "FROM refreshes LEFT JOIN loaded USING (seen) GROUP BY seen",
    _CALENDAR,
)

# -- a study of all seven policies ---------------------------------------------------------------------------
# Quality is read from the timelines as a user sees them, and from the state that each policy serves at the end.

SEVEN = {
    "immediate": ("{}", "timeline_immediate", "loads_immediate"),
    "full_refresh": ('{"every":6.0}', "timeline_full_refresh", "loads_full_refresh"),
    "hot_window": ('{"every":36.0,"full_every":120.0,"hot":24.0}', "timeline_hot_window", "loads_hot_window"),
    "lagged_reconcile": ('{"every":12.0,"lag":5.0}', "timeline_reconcile", "loads_reconcile"),
    "window_gate": ('{"lateness":12.0,"size":6.0}', "timeline_window_gate", "loads_window_gate"),
    "commit_snapshot": ('{"every":8.0}', "timeline_commit", "loads_commit"),
    "periodic_snapshot": ('{"every":76.0}', "timeline_periodic_snapshot", "loads_periodic_snapshot"),
}


def _last(column: str, table: str) -> str:
    return f"a <= (SELECT MAX({column}) FROM {table} WHERE t <= {AT_US})"


_SERVED_AT = {
    "immediate": snapshot("v", f"a <= {AT_US}"),
    "full_refresh": snapshot("v", _last("t", f"({grid_points('x', 6)})")),
    "hot_window": f"SELECT * FROM hot_state WHERE shown = (SELECT MAX(t) FROM points WHERE t <= {AT_US})",
    "lagged_reconcile": snapshot("v", _last("c", f"({reconcile_cuts('x', 12, 5)})")),
    "window_gate": snapshot(f"({gate(6, 12)})", f"a <= {AT_US}"),
    "commit_snapshot": snapshot("v", _last("t", "chain")),
    "periodic_snapshot": snapshot("v", _last("t", f"({grid_points('x', 76)})")),
}


def seven_ctes() -> list[str]:
    totals = ", ".join(
        f"(SELECT {TOTAL} FROM truth WHERE {w}) AS {n}_truth, (SELECT COUNT(*) FROM truth WHERE {w}) AS {n}_rows, "
        f"(SELECT {TOTAL} FROM served WHERE served.p = policies.p AND {w}) AS {n}_served"
        for n, w in (("l", period(None)), ("d", period(24, 8)), ("w", period(168)))
    )
    timelines = " UNION ALL ".join(
        f"SELECT '{p}' AS p, epoch_us(arrival_time) AS t, value, epoch_us(max_visible_arrival_time) AS c FROM ({ORACLES[line]})"
        for p, (_, line, _) in SEVEN.items()
    )
    return [
        commit_chain(8),
        hot_entries(24, 36, 120),
        HOT_STATE,
        f"policies(p) AS (VALUES {', '.join(f"('{p}')" for p in SEVEN)})",
        f"truth AS ({snapshot('v', f'a <= {AT_US}')})",
        "served AS (" + " UNION ALL ".join(f"SELECT '{p}' AS p, e, m FROM ({q})" for p, q in _SERVED_AT.items()) + ")",
        f"line AS MATERIALIZED (SELECT * FROM ({timelines}) WHERE t <= {AT_US})",
        f"""aligned AS (
          SELECT r.p, r.a, line.c FROM (SELECT p, a FROM policies, (SELECT DISTINCT a FROM v WHERE a <= {AT_US})) AS r
          ASOF LEFT JOIN line ON r.p = line.p AND r.a >= line.t)""",
        """fresh AS (
          SELECT p, MAX(lag) AS longest, QUANTILE_CONT(lag, 0.95) AS p95, COUNT(*) FILTER (c IS NULL) AS unserved
          FROM (SELECT p, c, GREATEST(a - COALESCE(c, t0), 0) / 6e7 AS lag FROM aligned, b) GROUP BY p)""",
        """still AS (
          SELECT p, COUNT(*) AS transitions, COUNT(*) FILTER (change > 1e-6) AS revisions,
            COALESCE(SUM(change) FILTER (change > 1e-6), 0) AS moved, COALESCE(MAX(change) FILTER (change > 1e-6), 0) AS most
          FROM (
            SELECT p, ABS(value - LAG(value) OVER w) AS change, c = LAG(c) OVER w AS same
            FROM line WINDOW w AS (PARTITION BY p ORDER BY t)
          ) WHERE same GROUP BY p)""",
        "loaded AS (" + " UNION ALL ".join(
            f"SELECT '{p}' AS p, CAST(SUM(load_count) AS BIGINT) AS loaded FROM ({ORACLES[q]})" for p, (_, _, q) in SEVEN.items()
        ) + ")",
        TARGETS,
        f"""out AS (
          SELECT *, {ratio('l_truth', 'l_served')} AS l_ratio, {ratio('d_truth', 'd_served')} AS d_ratio,
            {ratio('w_truth', 'w_served')} AS w_ratio, longest <= f_target + 1e-3 AS f_pass
          FROM targets, (SELECT p, {totals} FROM policies)
          JOIN fresh USING (p) JOIN loaded USING (p) LEFT JOIN still USING (p))""",
    ]


ORACLES["evaluate_seven_policies"] = outcome_query(
    "CASE p " + " ".join(f"WHEN '{p}' THEN '{json}'" for p, (json, _, _) in SEVEN.items()) + " END",
    (
        "CAST(COALESCE(revisions, 0) AS DOUBLE)", "COALESCE(revisions / transitions, 0.0)",
        "ROUND(COALESCE(moved, 0.0), 6)", "ROUND(COALESCE(most, 0.0), 6)",
    ),
    *seven_ctes(),
    recursive=True,
)
ORACLES["pass_matrix_seven_policies"] = with_log(
    f"""SELECT scenario, {', '.join(
        f"MAX(CASE WHEN p = '{p}' THEN (CASE WHEN {MET} AND COALESCE(COALESCE(revisions / transitions, 0) <= s_target + 1e-9, TRUE) "
        f"THEN 'PASS' ELSE 'FAIL' END) END) AS {p}" for p in SEVEN)}
    FROM out GROUP BY scenario""",
    *seven_ctes(),
    recursive=True,
)

# A timeline with stretches that have no horizon, read at every day on which an order was placed.
ORACLES["freshness_with_gaps"] = f"""
WITH {HISTORY}, {NORMALISED}, aligned AS (
  SELECT r.policy, r.at_time, n.max_visible_arrival_time AS c
  FROM (SELECT * FROM (SELECT DISTINCT policy FROM normalised), (SELECT DISTINCT o_orderdate AS at_time FROM orders)) AS r
  ASOF LEFT JOIN normalised AS n ON n.policy = r.policy AND r.at_time >= n.arrival_time
), lags AS (
  SELECT policy, c, GREATEST(epoch_us(at_time) - epoch_us(COALESCE(c, (SELECT MIN(o_orderdate) FROM orders))), 0) / 6e7 AS lag
  FROM aligned
)
SELECT policy, ROUND(MAX(lag), 6) AS freshness_max_minutes, ROUND(QUANTILE_CONT(lag, 0.95), 6) AS freshness_p95_minutes,
  COUNT(*) FILTER (c IS NULL) AS freshness_unserved_points
FROM lags GROUP BY policy"""
ORACLES["saved_outcomes"] = f"SELECT *, 'scenarios' AS run_type FROM ({ORACLES['evaluate_seven_policies']})"
# The bound is an arrival of the log, so that a half-open range gives other rows than a closed one.
_AN_ARRIVAL = "(SELECT MAX(arrival_time) FROM log WHERE arrival_time <= TIMESTAMP '2024-01-22 00:00:00')"
ORACLES["arrived_from_an_arrival"] = with_log(f"{WHOLE_LOG} WHERE arrival_time >= {_AN_ARRIVAL} AND arrival_time <= {AT}")
ORACLES["increment_from_an_arrival"] = with_log(f"{WHOLE_LOG} WHERE arrival_time > {_AN_ARRIVAL} AND arrival_time <= {AT}")
ORACLES["timeline_kept"] = f"SELECT arrival_time, event_count, value FROM ({ORACLES['timeline_immediate']})"
ORACLES["timeline_of_observed_log"] = ORACLES["timeline_full_refresh"]
