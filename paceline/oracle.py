"""The registered queries as plain SQL over the same tables, for an independent check."""

from __future__ import annotations

import re

from paceline.model import ACTIVITY, MEASURES, STATISTICS

KEY_FEATURES = [f"{m}_mean" for m in MEASURES] + [f"ratio_{a}" for a in ACTIVITY]


def r(expr: str, alias: str | None = None) -> str:
    """Rounded double without a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


_MEASURE_OF = {"click": "ruminate", "view": "eat", "purchase": "graze", "signup": "rest", "error": "walk"}
_SUMS = ", ".join(f"sum(CASE WHEN event_type = '{e}' THEN value END) AS {m}" for e, m in _MEASURE_OF.items())
_NORMAL = "('unlabelled', 'Sin etiqueta', 'No anomaly', 'No Anomaly', 'None', '')"


def _pivot(grain: str) -> str:
    return f"""
    SELECT CAST(user_id AS VARCHAR) AS entity_id, date_trunc('{grain}', ts)::TIMESTAMP AS ts, {_SUMS}, sum(k) AS steps,
      CASE WHEN max(k) >= 90 THEN 'Heat/Estrus' WHEN max(k) >= 80 THEN 'Other'
           WHEN max(k) >= 70 THEN 'No anomaly' END AS anomaly_label
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    GROUP BY 1, 2"""


def features(source: str, window: str, by: list[str], measures: list[str], acts: list[str], resolution: str = "", scale: str = "") -> str:
    """Window features of a labelled source, with the missing cells of all its data columns."""
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ["entity_id", "ts", *measures, "anomaly_label"])
    cols = []
    for m in measures:
        cols += [
            f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std", f"min({m}) AS {m}_min", f"max({m}) AS {m}_max",
            f"median({m}) AS {m}_median", f"quantile_cont({m}, 0.1) AS {m}_p10", f"quantile_cont({m}, 0.9) AS {m}_p90",
            f"quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS {m}_iqr",
            f"CASE WHEN avg({m}) <> 0 THEN stddev_samp({m}) / avg({m}) END AS {m}_cv",
        ]
    total = " + ".join(f"coalesce(sum({a}), 0)" for a in acts)
    cols += [f"CASE WHEN {total} > 0 THEN coalesce(sum({a}), 0) / ({total}) END AS ratio_{a}" for a in acts]
    keys = ", ".join([*by, "entity_id"])
    literal = "".join(f"'{v}' AS {k}, " for k, v in (("resolution", resolution), ("scale_type", scale)) if v)
    return f"""
    SELECT {keys}, date_trunc('{window}', ts)::TIMESTAMP AS window_start, {literal}
      count(*) AS n_records, CAST(sum({missing}) AS BIGINT) AS n_missing, {', '.join(cols)},
      count(*) FILTER (WHERE anomaly_label NOT IN {_NORMAL}) AS anomaly_count,
      count(*) FILTER (WHERE anomaly_label NOT IN {_NORMAL}) / count(*)::DOUBLE AS anomaly_rate
    FROM {source} GROUP BY ALL"""


def feature_list(measures=MEASURES, acts=ACTIVITY) -> list[str]:
    return [f"{m}_{s}" for m in measures for s in STATISTICS] + [f"ratio_{a}" for a in acts] + ["anomaly_rate"]


_COALESCED = ", ".join(f"coalesce({m}, 0.0) AS {m}" for m in MEASURES)
CTES = {
    "farms": """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_mktsegment AS dataset,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'extensive' ELSE 'intensive' END AS system FROM customer""",
    "raw_hourly": _pivot("hour"),
    "raw_daily": _pivot("day"),
    "hourly": "SELECT * FROM raw_hourly JOIN farms USING (entity_id)",
    "daily": "SELECT * FROM raw_daily JOIN farms USING (entity_id)",
    "clean": "SELECT * REPLACE (trim(coalesce(anomaly_label, 'unlabelled')) AS anomaly_label) FROM hourly",
    "log": """SELECT CAST(user_id AS VARCHAR) AS entity_id, date_trunc('day', ts)::TIMESTAMP AS event_date,
      CASE event_type WHEN 'error' THEN 'ANOMALY' WHEN 'signup' THEN 'HEAT' ELSE 'BIRTH' END AS event_type
      FROM events WHERE event_type IN ('error', 'signup', 'purchase')""",
    "half": "SELECT * FROM raw_daily WHERE ts < TIMESTAMP '2024-01-16'",
    "weekly": features("clean", "week", ["dataset", "system"], list(MEASURES), list(ACTIVITY), "hourly", "native"),
    "label_n": """SELECT dataset, system, entity_id, date_trunc('day', ts)::TIMESTAMP AS ts, anomaly_label, count(*) AS n
      FROM clean WHERE anomaly_label NOT IN """ + _NORMAL + " GROUP BY ALL",
    "label_1": """SELECT * FROM label_n
      QUALIFY row_number() OVER (PARTITION BY dataset, system, entity_id, ts ORDER BY n DESC, anomaly_label) = 1""",
    "day_sums": f"""SELECT dataset, system, entity_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n_source_rows,
      {', '.join(f'coalesce(sum({m}), 0.0) AS {m}' for m in MEASURES)},
      count(*) FILTER (WHERE anomaly_label NOT IN {_NORMAL}) AS anomaly_hours FROM clean GROUP BY ALL""",
    "days": """SELECT d.*, coalesce(l.anomaly_label, 'unlabelled') AS anomaly_label FROM day_sums d
      LEFT JOIN label_1 l USING (dataset, system, entity_id, ts)""",
    "branch_b": "SELECT * REPLACE (CASE WHEN dataset <> 'FURNITURE' THEN anomaly_count END AS anomaly_count, "
    "CASE WHEN dataset <> 'FURNITURE' THEN anomaly_rate END AS anomaly_rate) FROM ("
    + features("days", "week", ["dataset", "system"], list(MEASURES), list(ACTIVITY), "daily", "rolled up from hourly") + ")",
    "native_a": f"SELECT entity_id, ts AS day, {_COALESCED.replace('coalesce(steps, 0.0)', 'coalesce(steps + 1.0, 0.0)')} "
    "FROM daily",
    "hours_b": f"""SELECT entity_id, date_trunc('day', ts)::TIMESTAMP AS day,
      {', '.join(f'coalesce(sum({m}), 0.0) AS {m}' for m in MEASURES)}
      FROM hourly GROUP BY ALL""",
    "diffs": " UNION ALL ".join(
        f"SELECT '{m}' AS variable, abs(a.{m} - b.{m}) AS d FROM native_a a JOIN hours_b b USING (entity_id, day)" for m in MEASURES
    ),
    "reconciled": """SELECT variable, avg(d) AS mean_diff, max(d) AS max_diff, median(d) AS median_diff, count(*) AS n_pairs
      FROM diffs GROUP BY variable""",
    "profiles": f"""SELECT dataset, system, count(*) AS rows, count(DISTINCT entity_id) AS entities, CAST(sum(
      {' + '.join(f'CAST({c} IS NULL AS INT)' for c in ['entity_id', 'ts', *MEASURES, 'anomaly_label'])}) AS BIGINT) AS missing,
      min(ts) AS start, max(ts) AS "end", count(anomaly_label) AS labelled_rows,
      {', '.join(f'avg({m}) AS mean_{m}' for m in MEASURES)} FROM hourly GROUP BY ALL""",
    "all_times": "SELECT 'hourly' AS source, ts FROM raw_hourly UNION SELECT 'daily', ts FROM raw_daily",
    "gaps": """SELECT source, epoch_us(ts - lag(ts) OVER (PARTITION BY source ORDER BY ts)) / 3.6e9 AS g FROM all_times""",
    "ds_gaps": """SELECT dataset, epoch_us(ts - lag(ts) OVER (PARTITION BY dataset ORDER BY ts)) / 3.6e9 AS g
      FROM (SELECT DISTINCT dataset, ts FROM clean)""",
    "branches": "SELECT *, 0 AS rk FROM weekly UNION ALL BY NAME SELECT *, 1 AS rk FROM branch_b",
    "master": """SELECT * EXCLUDE (rk) FROM branches
      QUALIFY row_number() OVER (PARTITION BY dataset, system, entity_id, window_start ORDER BY rk) = 1""",
    "master_days": """SELECT * EXCLUDE (rk) FROM branches
      QUALIFY row_number() OVER (PARTITION BY dataset, system, entity_id, window_start ORDER BY rk DESC) = 1""",
    "key_values": "UNPIVOT (SELECT dataset, system, " + ", ".join(KEY_FEATURES) + " FROM weekly) ON "
    + ", ".join(KEY_FEATURES) + " INTO NAME variable VALUE x",
    "box_values": "SELECT variable, x FROM key_values WHERE variable LIKE '%_mean'",
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` with the shared CTEs it needs, dependencies first."""
    pool = {**CTES, **dict(extra)}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in pool:
            if name not in seen and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", text):
                seen.add(name)
                visit(pool[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({pool[n]})" for n in order) + "\n" + body


SQL: dict[str, str] = {}
_KS = "(SELECT CAST(range AS INT) AS k FROM range(2, 7))"

SQL["clean_activity"] = f"""
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN event_type <> 'signup' THEN ts END AS ts,
    {r("CASE WHEN event_type <> 'error' THEN value END", 'eat')},
    CASE WHEN event_type <> 'view' THEN event_type ELSE 'unlabelled' END AS anomaly_label FROM events"""
SQL["dedup_rows"] = sql("SELECT DISTINCT * FROM log")
SQL["event_log_clean"] = """
  SELECT date_trunc('day', ts)::TIMESTAMP AS event_date, upper(event_type) AS event_type, count(*) AS n FROM events GROUP BY ALL"""
SQL["window_floor"] = """
  SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, date_trunc('week', ts)::TIMESTAMP AS week_start,
    date_trunc('month', ts)::TIMESTAMP AS month_start, count(*) AS n FROM events GROUP BY ALL"""
SQL["rescale_daily_equivalent"] = sql(
    f"SELECT entity_id, ts, {', '.join(r(f'{m} * 24', m) for m in MEASURES)} FROM raw_daily")
SQL["anomaly_rows"] = sql(
    f"SELECT entity_id, ts, dataset, system, anomaly_label, {rs(*MEASURES)} FROM clean WHERE anomaly_label NOT IN {_NORMAL}")
SQL["select_sources"] = sql("""
  SELECT CASE dataset WHEN 'BUILDING' THEN 'member' ELSE 'substring' END AS pick, dataset, count(*) AS n
  FROM clean WHERE dataset = 'BUILDING' OR dataset ILIKE '%house%' GROUP BY ALL""")
SQL["profile"] = sql(f"""
  SELECT dataset, count(*) AS rows, count(DISTINCT entity_id) AS entities,
    CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in ['entity_id', 'ts', *MEASURES, 'anomaly_label'])}) AS BIGINT) AS missing,
    min(ts) AS start, max(ts) AS "end", 9 AS columns, {r('any_value(m)', 'median_gap_hours')},
    CASE WHEN any_value(m) IS NULL THEN 'unknown' WHEN any_value(m) >= 12 THEN 'daily' ELSE 'hourly' END AS frequency,
    any_value(tops) AS top_labels
  FROM clean LEFT JOIN (SELECT dataset, median(g) AS m FROM ds_gaps GROUP BY dataset) USING (dataset)
  LEFT JOIN (SELECT dataset, string_agg(label || ':' || n, ',' ORDER BY k) AS tops FROM (
    SELECT dataset, anomaly_label AS label, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, anomaly_label) AS k
    FROM clean GROUP BY 1, 2) WHERE k <= 5 GROUP BY dataset) USING (dataset) GROUP BY dataset""")
SQL["compare_profiles"] = sql(f"""
  SELECT * REPLACE ({', '.join(f'round(mean_{m}, 6) + 0.0 AS mean_{m}' for m in MEASURES)}), 9 AS columns FROM profiles JOIN (
    SELECT dataset, system, anomaly_label AS top_label, count(*) AS top_label_count FROM clean GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY dataset, system ORDER BY count(*) DESC, anomaly_label) = 1) t USING (dataset, system)""")
SQL["system_means"] = sql(
    f"SELECT system, {', '.join(r(f'avg(mean_{m})', f'mean_{m}') for m in MEASURES)} FROM profiles GROUP BY system")
SQL["infer_frequency"] = sql(f"""
  SELECT source, {r('median(g)', 'median_gap_hours')},
    CASE WHEN median(g) IS NULL THEN 'unknown' WHEN median(g) >= 12 THEN 'daily' ELSE 'hourly' END AS frequency
  FROM gaps GROUP BY source""")
SQL["top_labels"] = sql("""
  SELECT anomaly_label AS label, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, label LIMIT 3""")
SQL["missing_by_column"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing FROM hourly HAVING count(*) > count({c})"
    for c in ["entity_id", "ts", *MEASURES, "anomaly_label", "dataset", "system"]))
SQL["group_counts"] = sql("""
  SELECT system, dataset, count(*) AS n, CAST(grouping(system, dataset) AS BIGINT) AS level FROM clean
  GROUP BY GROUPING SETS ((system), (dataset), (system, dataset))""")
SQL["branch_summary"] = sql("""
  SELECT count(*) AS n_rows, count(DISTINCT system) AS n_systems, CASE WHEN count(DISTINCT system) = 1 THEN min(system) END AS only_system
  FROM weekly UNION ALL
  SELECT count(*), count(DISTINCT system), CASE WHEN count(DISTINCT system) = 1 THEN min(system) END FROM weekly WHERE system = 'extensive'""")

SQL["rollup_daily"] = sql(
    f"SELECT dataset, system, entity_id, ts, n_source_rows, {rs(*MEASURES)}, anomaly_label, anomaly_hours FROM days")
SQL["modal_label"] = sql(f"""
  SELECT entity_id, window_start, coalesce(max(anomaly_label) FILTER (WHERE k = 1), 'unlabelled') AS label FROM (
    SELECT entity_id, window_start, anomaly_label, row_number() OVER (PARTITION BY entity_id, window_start ORDER BY n DESC, anomaly_label) AS k
    FROM (SELECT entity_id, date_trunc('week', ts)::TIMESTAMP AS window_start,
            CASE WHEN anomaly_label NOT IN {_NORMAL} THEN anomaly_label END AS anomaly_label,
            count(CASE WHEN anomaly_label NOT IN {_NORMAL} THEN 1 END) AS n FROM clean GROUP BY ALL))
  GROUP BY entity_id, window_start""")
_ACT_SUM = " + ".join(f"coalesce(sum({a}), 0)" for a in ACTIVITY)
SQL["audit_rollup"] = sql(f"""
  SELECT entity_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n_records,
    {', '.join(r(f'coalesce(sum({m}), 0)', f'sum_{m}') for m in MEASURES)}, {r(_ACT_SUM, 'sum_activity')}
  FROM clean GROUP BY 1, 2""")
SQL["classify_resolution"] = sql(f"""
  SELECT dataset, {r('median(n)', 'median_records')}, {r('avg(s)', 'mean_sum_activity')}, {r('median(s)', 'median_sum_activity')},
    CASE WHEN median(n) >= 12 THEN 'hourly' WHEN median(s) BETWEEN 800 AND 1440 THEN 'daily'
         WHEN median(s) BETWEEN 20 AND 60 THEN 'daily on hourly scale' ELSE 'undetermined' END AS classification
  FROM (SELECT dataset, entity_id, date_trunc('day', ts), count(*) AS n, {_ACT_SUM} AS s FROM clean GROUP BY 1, 2, 3) GROUP BY dataset""")
SQL["reconcile_rollups"] = sql(f"SELECT variable, {rs('mean_diff', 'max_diff', 'median_diff')}, n_pairs FROM reconciled")
SQL["reconcile_coverage"] = sql("""
  SELECT count(*) FILTER (WHERE a.day IS NOT NULL AND b.day IS NOT NULL) AS n_common,
    count(*) FILTER (WHERE b.day IS NULL) AS n_only_a, count(*) FILTER (WHERE a.day IS NULL) AS n_only_b
  FROM native_a a FULL JOIN hours_b b ON a.entity_id = b.entity_id AND a.day = b.day""")
SQL["reconcile_verdict"] = sql(f"""
  SELECT {r('max(max_diff)', 'worst_max_diff')}, {r('max(mean_diff)', 'worst_mean_diff')}, count(*) AS n_variables,
    CASE WHEN max(max_diff) IS NULL THEN 'not comparable' WHEN max(max_diff) <= 5 AND round(max(mean_diff), 9) <= 1 THEN 'coherent'
         ELSE 'different' END AS verdict FROM reconciled""")
SQL["rollup_report"] = sql(f"""
  SELECT dataset, count(*) AS rows, count(DISTINCT entity_id) AS entities, {r('avg(s)', 'mean_sum_activity')},
    {r('median(n_source_rows)', 'median_n_source_rows')}, {r('median(s)', 'median_sum_activity')},
    'hourly rows summed per entity and day' AS method
  FROM (SELECT *, {' + '.join(ACTIVITY)} AS s FROM days) GROUP BY dataset""")

SQL["events_in_activity_range"] = sql("""
  SELECT * FROM log WHERE event_date BETWEEN (SELECT min(ts) FROM half) AND (SELECT max(ts) FROM half)""")
_LABEL = """SELECT entity_id, event_date AS ts, CASE WHEN bool_or(event_type = 'ANOMALY') THEN 'ANOMALY'
    WHEN bool_or(event_type = 'HEAT') THEN 'HEAT' ELSE 'unlabelled' END AS lab FROM log GROUP BY 1, 2"""
SQL["label_from_events"] = sql(f"""
  SELECT entity_id, ts, {rs(*MEASURES)}, coalesce(lab, 'unlabelled') AS anomaly_label
  FROM raw_daily LEFT JOIN ({_LABEL}) USING (entity_id, ts)""")
SQL["label_without_coverage"] = sql("SELECT CAST(NULL AS VARCHAR) AS anomaly_label, count(*) AS n FROM raw_daily")
SQL["daily_equivalent"] = sql(f"""
  SELECT entity_id, ts, {', '.join(r(f'{m} * 24', m) for m in MEASURES)}, coalesce(lab, 'unlabelled') AS anomaly_label
  FROM raw_daily LEFT JOIN ({_LABEL}) USING (entity_id, ts)""")
_HALF_SUM = " + ".join(f"coalesce({a}, 0)" for a in ACTIVITY)
SQL["rescale_report"] = sql(f"""
  SELECT 'daily_equivalent' AS dataset, count(*) AS rows, count(DISTINCT entity_id) AS entities, 24.0::DOUBLE AS factor,
    '{','.join(MEASURES)}' AS scaled_columns, {r(f'avg(24 * ({_HALF_SUM}))', 'mean_sum_activity')},
    {r(f'median(24 * ({_HALF_SUM}))', 'median_sum_activity')}, (SELECT count(*) FROM log) AS events_total,
    (SELECT count(*) FROM log WHERE event_date BETWEEN (SELECT min(ts) FROM raw_daily) AND (SELECT max(ts) FROM raw_daily)) AS events_in_range,
    (SELECT min(event_date) FROM log) AS events_start, (SELECT max(event_date) FROM log) AS events_end,
    min(ts) AS activity_start, max(ts) AS activity_end, 'labels derived from events within the activity period' AS note FROM raw_daily""")
SQL["event_counts"] = sql("SELECT event_type, count(*) AS n FROM log GROUP BY 1")
SQL["entity_event_summary"] = sql("""
  SELECT entity_id, count(event_type) AS event_total, count(*) FILTER (WHERE event_type = 'ANOMALY') AS anomaly_events,
    count(*) FILTER (WHERE event_type = 'HEAT') AS heat_events, count(*) FILTER (WHERE event_type = 'BIRTH') AS birth_events,
    min(event_date) AS first_event_date, max(event_date) AS last_event_date,
    entity_id IN (SELECT entity_id FROM raw_daily) AS has_activity FROM log GROUP BY entity_id""")
SQL["common_entities"] = sql("""
  SELECT entity_id FROM raw_daily INTERSECT SELECT entity_id FROM log ORDER BY entity_id LIMIT 10""")
SQL["temporal_overlap"] = sql("""
  SELECT a.*, e.*, activity_start IS NOT NULL AND events_start IS NOT NULL
    AND greatest(activity_start, events_start) <= least(activity_end, events_end) AS temporal_overlap
  FROM (SELECT min(ts) AS activity_start, max(ts) AS activity_end FROM half) a,
    (SELECT min(event_date) AS events_start, max(event_date) AS events_end FROM log) e""")
SQL["integration_report"] = sql(f"""
  SELECT count(*) AS activity_rows, count(DISTINCT entity_id) AS activity_entities,
    CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in ['entity_id', 'ts', *MEASURES, 'anomaly_label'])}) AS BIGINT) AS activity_missing,
    min(ts) AS activity_start, max(ts) AS activity_end, any_value(er) AS event_rows, any_value(ee) AS event_entities,
    any_value(es) AS events_start, any_value(ed) AS events_end, any_value(ek) AS event_kinds,
    (SELECT count(*) FROM (SELECT entity_id FROM raw_daily INTERSECT SELECT entity_id FROM log)) AS common_entities,
    (SELECT string_agg(entity_id, ',' ORDER BY entity_id) FROM (SELECT entity_id FROM raw_daily INTERSECT
      SELECT entity_id FROM log ORDER BY entity_id LIMIT 10)) AS sample,
    min(ts) <= any_value(ed) AND any_value(es) <= max(ts) AS overlap
  FROM raw_daily, (SELECT count(*) AS er, count(DISTINCT entity_id) AS ee, min(event_date) AS es, max(event_date) AS ed,
    count(DISTINCT event_type) AS ek FROM log)""")

_F = rs(*feature_list())
_K = "entity_id, window_start, n_records, n_missing, anomaly_count"
SQL["weekly_features"] = sql(f"SELECT dataset, system, resolution, scale_type, {_K}, {_F} FROM weekly")
SQL["daily_features"] = sql(
    f"SELECT dataset, system, {_K}, {_F} FROM f",
    ("f", features("clean", "day", ["dataset", "system"], list(MEASURES), list(ACTIVITY))))
SQL["monthly_features"] = sql(
    f"SELECT dataset, system, {_K}, {_F} FROM f",
    ("f", features("clean", "month", ["dataset", "system"], list(MEASURES), list(ACTIVITY))))
SQL["stream_daily"], SQL["stream_weekly"] = SQL["rollup_daily"], SQL["weekly_features"]
# values of the group itself instead of interpolated ones
_AT_RANK = re.sub(r"median\((\w+)\)", r"quantile_disc(\1, 0.5)", features("clean", "month", ["dataset", "system"], list(MEASURES), list(ACTIVITY)).replace("quantile_cont", "quantile_disc"))
SQL["sketch_monthly"] = sql(f"SELECT dataset, system, {_K}, {_F} FROM f", ("f", _AT_RANK))
SQL["sketch_sources"] = sql(" UNION ALL ".join(
    f"""SELECT dataset, system, date_trunc('month', ts)::TIMESTAMP AS window_start, '{m}' AS variable, count({m}) AS n, {r(f'avg({m})', 'mean')},
      {r(f'stddev_samp({m})', 'std')}, {r(f'min({m})', 'min')}, {r(f'max({m})', 'max')}, true AS within FROM clean GROUP BY ALL"""
    for m in ("eat", "rest", "steps")))
_ORDER = ["ruminate", "eat", "graze", "rest"]
SQL["order_features"] = sql(
    f"SELECT 'orders' AS dataset, 'trade' AS system, {_K}, {rs(*feature_list(_ORDER, _ORDER))} FROM f",
    ("o", """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, l_shipdate AS ts, l_quantity AS ruminate, l_extendedprice AS eat,
       l_discount AS graze, l_tax AS rest, l_returnflag AS anomaly_label FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    ("f", features("o", "month", [], _ORDER, _ORDER)))
SQL["activity_ratios"] = sql(f"""
  SELECT entity_id, date_trunc('day', ts)::TIMESTAMP AS window_start,
    {', '.join(r(f'CASE WHEN {_ACT_SUM} > 0 THEN coalesce(sum({a}), 0) / ({_ACT_SUM}) END', f'ratio_{a}') for a in ACTIVITY)}
  FROM clean GROUP BY 1, 2""")
SQL["anomaly_rate"] = sql(f"""
  SELECT dataset, system, date_trunc('week', ts)::TIMESTAMP AS window_start, count(*) AS n_records,
    count(*) FILTER (WHERE anomaly_label NOT IN {_NORMAL}) AS anomaly_count,
    {r(f'count(*) FILTER (WHERE anomaly_label NOT IN {_NORMAL}) / count(*)::DOUBLE', 'anomaly_rate')} FROM clean GROUP BY 1, 2, 3""")
_COLS = f"dataset, system, resolution, scale_type, {_K}, {_F}"
SQL["branch_union"] = sql(f"SELECT {_COLS} FROM branches")
SQL["branch_union_gaps"] = sql(
    f"SELECT {_COLS} FROM (SELECT * REPLACE (CASE WHEN rk = 1 THEN rest_median END AS rest_median, CASE WHEN rk = 0 THEN eat_mean END AS eat_mean) FROM branches)")
SQL["master_table"] = sql(f"SELECT {_COLS} FROM master")
SQL["master_table_daily_first"] = sql(f"SELECT {_COLS} FROM master_days")
SQL["master_inputs"] = sql(f"""
  SELECT CASE rk WHEN 0 THEN 'hourly branch' ELSE 'daily branch' END AS "table", count(*) AS rows, {9 + len(feature_list())} AS columns,
    min(dataset) AS dataset, min(system) AS system FROM branches GROUP BY rk""")
_NUMERIC = ["n_records", "n_missing", *[f"{m}_{st}" for m in MEASURES for st in STATISTICS], *[f"ratio_{a}" for a in ACTIVITY], "anomaly_count", "anomaly_rate"]
SQL["numeric_summary"] = sql(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n_values FROM weekly" for c in _NUMERIC))
SQL["master_deliveries"] = SQL["master_table"]
SQL["master_report"] = sql(f"""
  SELECT count(*) AS rows, {9 + len(feature_list())} AS columns, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets,
    string_agg(DISTINCT system, ',' ORDER BY system) AS systems, count(DISTINCT entity_id) AS entities,
    min(window_start) AS window_start_min, max(window_start) AS window_start_max,
    CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in feature_list() + ['anomaly_count'])}) AS BIGINT) AS missing FROM master""")
SQL["feature_counts"] = sql("""
  SELECT dataset, system, resolution, scale_type, count(*) AS n FROM
    branches GROUP BY ALL""")

SQL["system_feature_means"] = sql(f"""
  SELECT variable, {r("avg(x) FILTER (WHERE system = 'extensive')", 'mean_extensive')},
    {r("avg(x) FILTER (WHERE system = 'intensive')", 'mean_intensive')} FROM key_values GROUP BY variable""")
SQL["histogram"] = sql(f"""
  SELECT e.variable, b.bin, {r('lo + (hi - lo) / 30 * (b.bin - 1)', 'lower')}, {r('lo + (hi - lo) / 30 * b.bin', 'upper')},
    coalesce(n, 0) AS n
  FROM (SELECT variable, min(x) AS lo, max(x) AS hi FROM key_values GROUP BY 1) e
  CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(1, 31)) b
  LEFT JOIN (SELECT variable, least(floor((x - lo) * 30 / (hi - lo)) + 1, 30) AS bin, count(*) AS n FROM key_values
    JOIN (SELECT variable, min(x) AS lo, max(x) AS hi FROM key_values GROUP BY 1) USING (variable) GROUP BY 1, 2) c
  ON c.variable = e.variable AND c.bin = b.bin""")
SQL["boxplot_stats"] = sql(f"""
  SELECT variable, {rs('q1', 'median', 'q3')},
    {r('least(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END), q1)', 'whisker_low')},
    {r('greatest(max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END), q3)', 'whisker_high')},
    count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM box_values JOIN (SELECT variable, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3
    FROM box_values GROUP BY 1) USING (variable) GROUP BY variable, q1, median, q3""")
SQL["correlation_matrix"] = sql(
    "SELECT a, b, round(c, 6) + 0.0 AS corr FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM weekly" for a in KEY_FEATURES for b in KEY_FEATURES)
    + ")")
SQL["group_centroids"] = sql(f"SELECT dataset, {r('avg(eat_mean)', 'eat_mean')}, {r('avg(rest_mean)', 'rest_mean')} FROM weekly GROUP BY 1")

_ABSOLUTE = [f"{m}_{st}" for m in MEASURES for st in STATISTICS]
_NO_COUNT = [f"{a}_{st}" for a in ACTIVITY for st in STATISTICS]


def _medians(columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in columns) + " FROM weekly"


def _filled(columns: list[str]) -> str:
    return "SELECT dataset, system, entity_id, window_start, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in columns) + " FROM weekly, medians"


SQL["impute_median"] = sql(
    f"SELECT dataset, system, entity_id, window_start, {rs(*_ABSOLUTE)} FROM filled",
    ("medians", _medians(_ABSOLUTE)), ("filled", _filled(_ABSOLUTE)))
SQL["standardize"] = sql(
    "SELECT dataset, system, entity_id, window_start, "
    + ", ".join(f"round(({c} - mu_{c}) / CASE WHEN sd_{c} > 1e-10 * greatest(1, abs(mu_{c})) THEN sd_{c} ELSE 1 END, 6) + 0.0 AS {c}" for c in _NO_COUNT)
    + " FROM filled, moments",
    ("medians", _medians(_NO_COUNT)), ("filled", _filled(_NO_COUNT)),
    ("moments", "SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _NO_COUNT) + " FROM filled"))
SQL["eta_squared"] = sql(" UNION ALL ".join(
    f"""SELECT '{v}' AS value, '{g}' AS grouping, round(sum(n * (mu - gm) * (mu - gm)) / any_value(st), 6) + 0.0 AS eta_squared
    FROM (SELECT {g}, count({v}) AS n, avg({v}) AS mu FROM weekly GROUP BY 1),
      (SELECT avg({v}) AS gm, var_pop({v}) * count({v}) AS st FROM weekly)"""
    for v in ("eat_mean", "steps_mean") for g in ("system", "dataset")))


# --- PCA by power iteration on the correlation matrix of the imputed columns ---------
_RATIOS = [f"ratio_{a}" for a in ACTIVITY]
_SETS = {"absolute": _ABSOLUTE, "ratios": _RATIOS, "absolute_no_count": _NO_COUNT}
_UNIT = "list_transform({0}, lambda z: z / sqrt(list_dot_product({0}, {0})))"


def _pca(s: str, columns: list[str], source: str = "weekly", steps: int = 3000) -> tuple[tuple[str, str], ...]:
    """CTEs ``zs_s`` (keys and scaled rows) and ``axes_s`` (two axes with their eigenvalues)."""
    n = len(columns)

    def power(name: str, matrix: str, start: str) -> list[tuple[str, str]]:
        step = _UNIT.format("list_transform(c, lambda r: list_dot_product(r, v))")
        return [
            (f"it{name}_{s}", f"SELECT 0 AS i, list_transform(range(1, {n + 1}), lambda i: {start}) AS v UNION ALL SELECT i + 1, {step} FROM it{name}_{s}, {matrix}_{s} WHERE i < {steps}"),
            (f"e{name}_{s}", f"SELECT v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM it{name}_{s}, {matrix}_{s} WHERE i = {steps}"),
        ]

    return (
        (f"med_{s}", "SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in columns) + f" FROM {source}"),
        (f"rat_{s}", "SELECT row_number() OVER () AS rid, dataset, system, entity_id, window_start, ["
         + ", ".join(f"coalesce({c}, m_{c})" for c in columns) + f"]::DOUBLE[] AS xs FROM {source}, med_{s}"),
        (f"cell_{s}", f"SELECT rid, unnest(range({n})) AS j, unnest(xs) AS x FROM rat_{s}"),
        (f"mom_{s}", f"SELECT j, avg(x) AS mu, stddev_pop(x) AS sd FROM cell_{s} GROUP BY j"),
        (f"sca_{s}", f"SELECT rid, j, (x - mu) / CASE WHEN sd > 1e-10 * greatest(1, abs(mu)) THEN sd ELSE 1 END AS z FROM cell_{s} JOIN mom_{s} USING (j)"),
        (f"zs_{s}", f"SELECT any_value(dataset) AS dataset, any_value(system) AS system, any_value(entity_id) AS entity_id, any_value(window_start) AS window_start, list(z ORDER BY j) AS z FROM sca_{s} JOIN rat_{s} USING (rid) GROUP BY rid"),
        (f"cov_{s}", f"SELECT a.j AS j, b.j AS k, sum(a.z * b.z) / (SELECT count(*) FROM rat_{s}) AS s FROM sca_{s} a JOIN sca_{s} b USING (rid) GROUP BY 1, 2"),
        (f"cm_{s}", f"SELECT list(r ORDER BY j) AS c FROM (SELECT j, list(s ORDER BY k) AS r FROM cov_{s} GROUP BY j)"),
        *power("1", "cm", "sin(i * 1.7) + 0.1"),
        (f"cm2_{s}", f"SELECT list_transform(range(1, {n + 1}), lambda a: list_transform(range(1, {n + 1}), lambda b: c[a][b] - l * v[a] * v[b])) AS c FROM cm_{s}, e1_{s}"),
        *power("2", "cm2", "cos(i * 2.3) - 0.2"),
        (f"axes_{s}", "SELECT list_transform(a.v, lambda x: x * CASE WHEN list_max(a.v) >= -list_min(a.v) THEN 1 ELSE -1 END) AS w1, "
         "list_transform(b.v, lambda x: x * CASE WHEN list_max(b.v) >= -list_min(b.v) THEN 1 ELSE -1 END) AS w2, "
         f"a.l AS l1, b.l AS l2, (SELECT sum(s) FROM cov_{s} WHERE j = k) AS total FROM e1_{s} a, e2_{s} b"),
    )


_PCA = _pca("r", _RATIOS)
_ALL_PCA = (*_pca("a", _ABSOLUTE), *_PCA, *_pca("n", _NO_COUNT))
_SUFFIX = {"absolute": "a", "ratios": "r", "absolute_no_count": "n"}


def _each_set(body) -> str:
    return " UNION ALL ".join(body(name, _SUFFIX[name], ", ".join(f"'{c}'" for c in columns)) for name, columns in _SETS.items())


SQL["pca_projection"] = sql(_each_set(lambda name, x, _: f"""
  SELECT '{name}' AS feature_set, dataset, system, entity_id, window_start, round(list_dot_product(z, w1), 4) + 0.0 AS pc1,
    round(list_dot_product(z, w2), 4) + 0.0 AS pc2 FROM zs_{x}, axes_{x}"""), *_ALL_PCA)
SQL["pca_loadings"] = sql(_each_set(lambda name, x, names: f"""
  SELECT '{name}' AS feature_set, variable, round(a, 4) + 0.0 AS pc1, round(b, 4) + 0.0 AS pc2, round(abs(a), 4) AS abs_pc1, round(abs(b), 4) AS abs_pc2
  FROM (SELECT unnest([{names}]) AS variable, unnest(w1) AS a, unnest(w2) AS b FROM axes_{x})"""), *_ALL_PCA)
SQL["pca_variance"] = sql(_each_set(lambda name, x, _: f"""
  SELECT '{name}' AS feature_set, 1 AS component, round(l1 / total, 5) AS explained, round(l1 / total, 5) AS cumulative FROM axes_{x} UNION ALL
  SELECT '{name}', 2, round(l2 / total, 5), round((l1 + l2) / total, 5) FROM axes_{x}"""), *_ALL_PCA)
SQL["pca_by_resolution"] = sql(
    " UNION ALL ".join(f"SELECT '{g}' AS part, round(l1 / total, 5) AS explained_pc1, round(l2 / total, 5) AS explained_pc2 FROM axes_{x}" for g, x in (("extensive", "x"), ("intensive", "i"))),
    ("ext", "SELECT * FROM weekly WHERE system = 'extensive'"), ("int", "SELECT * FROM weekly WHERE system = 'intensive'"),
    *_pca("x", _RATIOS, "ext"), *_pca("i", _RATIOS, "int"))
SQL["pca_by_resolution_absolute"] = sql(
    " UNION ALL ".join(f"SELECT '{g}' AS part, round(l1 / total, 5) AS explained_pc1, round(l2 / total, 5) AS explained_pc2 FROM axes_{x}" for g, x in (("extensive", "y"), ("intensive", "j"))),
    ("ext", "SELECT * FROM weekly WHERE system = 'extensive'"), ("int", "SELECT * FROM weekly WHERE system = 'intensive'"),
    *_pca("y", _ABSOLUTE, "ext"), *_pca("j", _ABSOLUTE, "int"))


def _share(x: str, axis: str, g: str) -> str:
    """Eta squared of a projection: between groups over all."""
    at = f"list_dot_product(z, {axis})"
    return f"""(SELECT sum(n * (mu - gm) * (mu - gm)) / any_value(st) FROM (SELECT {g}, count(*) AS n, avg({at}) AS mu FROM zs_{x}, axes_{x} GROUP BY 1),
      (SELECT avg({at}) AS gm, var_pop({at}) * count(*) AS st FROM zs_{x}, axes_{x}))"""


SQL["pca_summary"] = sql("""SELECT feature_set, n_rows, n_features, round(p1, 4) AS explained_pc1, round(p2, 4) AS explained_pc2, round(es, 4) + 0.0 AS eta_system,
    round(ed, 4) + 0.0 AS eta_dataset, round(es2, 4) + 0.0 AS eta_system_pc2, round(ed2, 4) + 0.0 AS eta_dataset_pc2,
    CASE WHEN ed > es + 0.1 THEN 'dataset-driven' WHEN es > ed + 0.1 THEN 'system-driven' ELSE 'confounded' END AS verdict FROM ("""
    + _each_set(lambda name, x, names: f"""
      SELECT '{name}' AS feature_set, (SELECT count(*) FROM weekly) AS n_rows, {names.count(",") + 1} AS n_features, l1 / total AS p1, l2 / total AS p2,
        {_share(x, "w1", "system")} AS es, {_share(x, "w1", "dataset")} AS ed, {_share(x, "w2", "system")} AS es2, {_share(x, "w2", "dataset")} AS ed2 FROM axes_{x}""")
    + ")", *_ALL_PCA)
SQL["projection_with_features"] = sql(f"""
  SELECT dataset, system, entity_id, window_start, round(list_dot_product(z, w1), 4) + 0.0 AS pc1,
    round(list_dot_product(z, w2), 4) + 0.0 AS pc2, {r('eat_mean')}, n_records FROM zs_r JOIN weekly USING (dataset, system, entity_id, window_start), axes_r""", *_PCA)
_BASE = f"regexp_replace(regexp_replace(variable, '_({'|'.join(STATISTICS)})$', ''), 'ratio_', '')"
SQL["top_loadings"] = sql(_each_set(lambda name, x, names: " UNION ALL ".join(f"""
  SELECT '{name}' AS feature_set, {c} AS component, (SELECT string_agg(base, ',' ORDER BY size DESC, base) FROM (SELECT {_BASE} AS base, max(abs(a)) AS size
      FROM (SELECT * FROM (SELECT unnest([{names}]) AS variable, unnest(w{c}) AS a FROM axes_{x}) ORDER BY abs(a) DESC, variable LIMIT 5) GROUP BY 1)) AS base_variables,
    variable AS top_variable, round(a, 4) AS top_loading, CASE WHEN a > 0 THEN 'positive' ELSE 'negative' END AS sign
  FROM (SELECT * FROM (SELECT unnest([{names}]) AS variable, unnest(w{c}) AS a FROM axes_{x}) ORDER BY abs(a) DESC, variable LIMIT 1)""" for c in (1, 2))), *_ALL_PCA)


def _eta(v: str, g: str, where: str) -> str:
    return f"""(SELECT sum(n * (mu - gm) * (mu - gm)) / any_value(st) FROM
      (SELECT {g}, count({v}) AS n, avg({v}) AS mu FROM weekly WHERE {where} GROUP BY 1),
      (SELECT avg({v}) AS gm, var_pop({v}) * count({v}) AS st FROM weekly WHERE {where}))"""


SQL["eta_verdict"] = sql(
    """SELECT n_rows, n_systems, part, measure, round(es, 6) + 0.0 AS eta_system, round(ed, 6) + 0.0 AS eta_dataset,
    CASE WHEN n_systems < 2 THEN CASE WHEN ed < 0.15 THEN 'not comparable, low' ELSE 'not comparable, notable' END
      WHEN ed > es + 0.1 THEN 'dataset-driven' WHEN es > ed + 0.1 THEN 'system-driven' ELSE 'confounded' END AS verdict FROM ("""
    + " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, count(DISTINCT system) AS n_systems, '{p}' AS part, '{m}' AS measure,
        {_eta(f'{m}_mean', 'system', w)} AS es, {_eta(f'{m}_mean', 'dataset', w)} AS ed FROM weekly WHERE {w}"""
        for m in MEASURES for p, w in (("all", "true"), ("extensive", "system = 'extensive'"))
    ) + ")")

# --- neighbours, clusters and scores over all pairs (small tables only) -----------
_VEC = ("vec", "SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings")
_RAT_VEC = ("vec", "SELECT concat_ws('|', dataset, system, entity_id, strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS id, z AS e FROM zs_r")
_PAIRS = ("pairs", "SELECT a.id AS a, b.id AS b, list_distance(a.e, b.e) AS d FROM vec a, vec b")


def _kth(k: int) -> tuple[str, str]:
    return f"k{k}", f"SELECT a AS id, d AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = {k}"


def _density(p: float, min_samples: int) -> tuple[tuple[str, str], ...]:
    return (
        _PAIRS, _kth(min_samples),
        ("near", f"SELECT a, b FROM pairs WHERE d <= (SELECT quantile_cont(distance, {p}) FROM k{min_samples})"),
        ("core", f"SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {min_samples}"),
        ("links", "SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)"),
        ("reach", "SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id"),
        ("cored", "SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)"),
        ("placed", "SELECT id, cluster FROM cored UNION ALL SELECT a, min(cluster) FROM near JOIN cored ON cored.id = near.b "
         "WHERE a NOT IN (SELECT id FROM core) GROUP BY a"),
    )


SQL["knn_distance"] = sql(f"SELECT id, {r('distance')} FROM k5", _VEC, _PAIRS, _kth(5))
SQL["eps_percentiles"] = sql(
    " UNION ALL ".join(
        f"SELECT {k} AS min_samples, {p} AS percentile, {r(f'quantile_cont(distance, {p / 100})', 'eps')} FROM k{k}"
        for k in (5, 10) for p in (50, 75, 90)
    ), _VEC, _PAIRS, _kth(5), _kth(10))
SQL["dbscan"] = sql(
    "SELECT id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM vec LEFT JOIN placed USING (id)", _VEC, *_density(0.75, 5))
SQL["dbscan_activity"] = sql("""
  SELECT dataset, system, entity_id, window_start, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM zs_r
  LEFT JOIN placed ON placed.id = concat_ws('|', dataset, system, entity_id, strftime(window_start, '%Y-%m-%d %H:%M:%S'))""",
    _RAT_VEC, *_PCA[:6], *_density(0.90, 5))

_LABELLED = ("labelled", "SELECT id, e, config, cluster FROM (SELECT id, e, unnest([0, 1, 2, 3]) AS config, "
             "unnest([label, label % 2, label % 3, label - 1]) AS cluster FROM vec) WHERE cluster >= 0")


def _sil(power: str) -> tuple[tuple[str, str], ...]:
    return (
        ("to_clusters", f"""SELECT p.config, p.id, p.cluster AS own, q.cluster, count(*) AS size, sum({power}) AS total
          FROM labelled p JOIN labelled q ON p.config = q.config JOIN pairs ON pairs.a = p.id AND pairs.b = q.id GROUP BY ALL"""),
        ("ab", """SELECT config, id, own AS cluster, max(size) FILTER (WHERE own = cluster) AS size,
          max(total / (size - 1)) FILTER (WHERE own = cluster AND size > 1) AS a, min(total / size) FILTER (WHERE own <> cluster) AS b
          FROM to_clusters GROUP BY ALL"""),
        ("sil", "SELECT config, id, cluster, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab WHERE b IS NOT NULL"),
    )


SQL["silhouette"] = sql(
    f"SELECT CAST(config AS INT) AS config, CAST(cluster AS INT) AS cluster, count(*) AS n, {r('avg(s)', 'silhouette')} FROM sil GROUP BY config, cluster",
    _VEC, _PAIRS, _LABELLED, *_sil("d"))
SQL["silhouette_squared"] = sql(
    f"SELECT CAST(config AS INT) AS config, {r('avg(s)', 'silhouette_squared')} FROM sil GROUP BY config",
    _VEC, _PAIRS, _LABELLED, *_sil("d * d"))
_CENTRES = (
    ("cells", "SELECT config, cluster, id, unnest(range(64)) AS dim, unnest(e) AS x FROM labelled"),
    ("centre", "SELECT config, cluster, dim, avg(x) AS m, var_pop(x) * count(*) AS ss, count(*) AS n FROM cells GROUP BY ALL"),
    ("centre_list", "SELECT config, cluster, list(m ORDER BY dim) AS m, max(n) AS n FROM centre GROUP BY ALL"),
    ("spread", """SELECT config, cluster, m, avg(list_distance(e, m)) AS s FROM labelled JOIN centre_list USING (config, cluster)
      GROUP BY ALL"""),
    ("db", """SELECT config, avg(w) AS davies_bouldin FROM (SELECT a.config, a.cluster, max((a.s + b.s) / list_distance(a.m, b.m)) AS w
      FROM spread a JOIN spread b ON a.config = b.config AND a.cluster <> b.cluster GROUP BY ALL) GROUP BY config"""),
    ("grand", "SELECT config, dim, avg(x) AS g FROM cells GROUP BY ALL"),
    ("ch", """SELECT config, sum(n * (m - g) * (m - g)) * (max(rows) - max(k)) / (sum(ss) * (max(k) - 1)) AS calinski_harabasz
      FROM centre JOIN grand USING (config, dim) JOIN (SELECT config, count(*) AS rows, count(DISTINCT cluster) AS k FROM labelled GROUP BY ALL)
      USING (config) GROUP BY config"""),
)
SQL["davies_bouldin"] = sql(
    f"SELECT CAST(config AS INT) AS config, {r('davies_bouldin')} FROM db", _VEC, _LABELLED, *_CENTRES)
SQL["calinski_harabasz"] = sql(
    f"SELECT CAST(config AS INT) AS config, {r('calinski_harabasz')} FROM ch", _VEC, _LABELLED, *_CENTRES)
_GIVEN = ("given", """SELECT config, count(DISTINCT cluster) AS n_clusters, (SELECT count(*) FROM vec) - count(*) AS n_noise,
  (SELECT count(*) FROM vec) AS n_rows FROM labelled GROUP BY config""")
SQL["best_config"] = sql(f"""
  SELECT 'dbscan' AS algorithm, 'given ' || config AS params, n_clusters, n_noise, {rs('silhouette', 'davies_bouldin', 'calinski_harabasz')}, n_rows
  FROM given JOIN (SELECT config, avg(s) AS silhouette FROM sil GROUP BY config) USING (config) JOIN db USING (config) JOIN ch USING (config)
  ORDER BY silhouette DESC LIMIT 1""", _VEC, _PAIRS, _LABELLED, *_sil("d"), *_CENTRES, _GIVEN)
SQL["degenerate_flag"] = sql("""
  SELECT 'given ' || config AS params, n_clusters, n_noise, n_clusters > 9 OR n_noise / n_rows::DOUBLE > 0.05 AS degenerate FROM given""",
    _VEC, _LABELLED, _GIVEN)

# --- interpretation ---------------------------------------------------------------
_RLIST = "[" + ", ".join(_RATIOS) + "]"
_DOM = ("dom", f"""SELECT dataset, system, entity_id, window_start, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS week,
  CAST(CASE WHEN ratio_eat IS NULL THEN -1 ELSE list_position({_RLIST}, list_max({_RLIST})) - 1 END AS INT) AS cluster FROM weekly""")
SQL["contingency"] = sql("""
  SELECT cluster, count(*) FILTER (WHERE system = 'extensive') AS extensive, count(*) FILTER (WHERE system = 'intensive') AS intensive
  FROM dom GROUP BY cluster""", _DOM)
_PURE = ("pure", """SELECT entity_id, arg_max(cluster, n * 100 - cluster) AS dominant_cluster, max(n) / sum(n) AS purity,
  CAST(sum(n) AS BIGINT) AS n_windows FROM (SELECT entity_id, cluster, count(*) AS n FROM dom WHERE entity_id IS NOT NULL GROUP BY ALL)
  GROUP BY entity_id""")
SQL["entity_purity"] = sql(f"SELECT entity_id, dominant_cluster, {r('purity')}, n_windows FROM pure", _DOM, _PURE)
SQL["mean_purity"] = sql(f"SELECT {r('avg(purity)', 'mean_purity')} FROM pure", _DOM, _PURE)
SQL["relation_strength"] = sql(
    """SELECT n_categories, category, relation, CASE WHEN n_categories > 1 THEN round(s, 6) END AS min_share,
    CASE WHEN relation = 'not evaluable' THEN 'system constant' WHEN s > 0.85 THEN 'consistent with system'
      WHEN s > 0.65 THEN 'partly consistent with system' ELSE 'not attributable to system' END AS reading FROM (
    SELECT *, CASE WHEN n_categories <= 1 THEN 'not evaluable' WHEN s > 0.85 THEN 'strong' WHEN s > 0.65 THEN 'moderate' ELSE 'none' END AS relation
    FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS category, count(*) AS n_categories, min(top / total) AS s FROM
        (SELECT {c}, sum(n) AS total, max(n) AS top FROM (SELECT {c}, cluster, count(*) AS n FROM dom GROUP BY ALL) GROUP BY {c})"""
        for c in ("system", "dataset", "week")
    ) + "))", _DOM)

# --- clustering grids: what must hold whatever the seeds --------------------------------
SQL["kmeans_grid"] = f"SELECT k, (SELECT count(*) FROM embeddings) AS n_rows, CAST(k AS BIGINT) AS n_clusters, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_off_centre FROM {_KS}"
SQL["gmm_grid"] = sql(f"SELECT k, (SELECT count(*) FROM weekly) AS n_rows, 0::BIGINT AS n_bad_shares, 0 AS n_bad_weights, 0 AS n_falls FROM {_KS}")
SQL["hierarchical_grid"] = f"SELECT k, (SELECT count(*) FROM embeddings) AS n_rows, CAST(k AS BIGINT) AS n_clusters, 0::BIGINT AS n_torn FROM {_KS}"
_LABEL_CENTRES = """SELECT label, list(m ORDER BY dim) AS c, max(n)::DOUBLE AS n FROM (
  SELECT label, dim, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY label"""
#: state: list of groups, each with its smallest label, its labels, its centre and its rows; the cheapest pair joins
SQL["ward_labels"] = f"""
WITH RECURSIVE start AS ({_LABEL_CENTRES}),
w AS (
  SELECT 0 AS step, list({{'low': label, 'members': [label], 'c': c, 'n': n}} ORDER BY label) AS g FROM start
  UNION ALL
  SELECT step + 1, list_concat(list_filter(g, lambda y, q: q <> p[1] AND q <> p[2]), [{{
      'low': least(g[p[1]].low, g[p[2]].low), 'members': list_concat(g[p[1]].members, g[p[2]].members),
      'c': list_transform(list_zip(g[p[1]].c, g[p[2]].c), lambda z: (z[1] * g[p[1]].n + z[2] * g[p[2]].n) / (g[p[1]].n + g[p[2]].n)),
      'n': g[p[1]].n + g[p[2]].n}}])
  FROM (SELECT step, g, list_sort(flatten(list_transform(range(1, len(g) + 1), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j:
          {{'d': g[i].n * g[j].n / (g[i].n + g[j].n) * list_distance(g[i].c, g[j].c) ^ 2, 'i': i, 'j': j}}))))[1] AS b FROM w WHERE len(g) > 2),
    LATERAL (SELECT [b.i, b.j] AS p))
SELECT CAST(len(g) AS INT) AS k, unnest(x.members) AS label, x.low AS lowest_label FROM (SELECT g, unnest(g) AS x FROM w) WHERE len(g) BETWEEN 2 AND 6"""
_PC = ("vec", "SELECT concat_ws('|', dataset, system, entity_id, strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS id, [list_dot_product(z, w1), list_dot_product(z, w2)] AS e FROM zs_r, axes_r")
_EPS = ("eps", " UNION ALL ".join(f"SELECT {m} AS min_samples, {p} AS percentile, quantile_cont(distance, {p / 100}) AS eps FROM k{m}" for m in (5, 10) for p in (50, 75, 90)))
SQL["evaluate_grid"] = sql(f"""
  SELECT algorithm, k, CASE WHEN algorithm = 'agglomerative' THEN 512 END AS micro, NULL::INT AS min_samples, NULL::INT AS percentile, NULL::DOUBLE AS eps,
    CAST(k AS BIGINT) AS n_clusters, true AS scored FROM {_KS}, (SELECT unnest(['kmeans', 'agglomerative', 'gmm']) AS algorithm)
  UNION ALL SELECT 'dbscan', NULL, NULL, min_samples, min(percentile), round(arg_min(eps, percentile), 4) + 0.0, NULL, true FROM eps
  WHERE eps > 0 GROUP BY min_samples, round(eps, 4)""", _PC, *_PCA, _PAIRS, _kth(5), _kth(10), _EPS)
def _density_setting(min_samples: int, percentile: int) -> str:
    """Clusters and scores of one density setting, from all pairs."""
    cells = [(n, body.replace("range(64)", f"range({len(_RATIOS)})")) for n, body in _CENTRES]
    return sql(f"""
      SELECT {min_samples} AS min_samples, {percentile} AS percentile, (SELECT quantile_cont(distance, {percentile / 100}) FROM k{min_samples}) AS eps,
        (SELECT count(DISTINCT cluster) FROM placed) AS n_clusters, (SELECT count(*) FROM vec) - (SELECT count(*) FROM placed) AS n_noise,
        (SELECT avg(s) FROM sil) AS silhouette, (SELECT max(davies_bouldin) FROM db) AS davies_bouldin, (SELECT max(calinski_harabasz) FROM ch) AS calinski_harabasz""",
        _RAT_VEC, *_PCA[:6], *_density(percentile / 100, min_samples), ("labelled", "SELECT id, e, 0 AS config, cluster FROM vec JOIN placed USING (id)"), *_sil("d"), *cells)


SQL["density_grid"] = """
  SELECT min_samples, percentile, round(eps, 4) + 0.0 AS eps, n_clusters, n_noise, round(silhouette, 4) + 0.0 AS silhouette,
    round(CASE WHEN silhouette IS NOT NULL THEN davies_bouldin END, 4) + 0.0 AS davies_bouldin, round(CASE WHEN silhouette IS NOT NULL THEN calinski_harabasz END, 4) + 0.0 AS calinski_harabasz
  FROM (""" + " UNION ALL ".join(f"SELECT * FROM ({_density_setting(m, p)})" for m in (5, 10) for p in (50, 75, 90)) + """)
  WHERE eps > 0 QUALIFY row_number() OVER (PARTITION BY min_samples, round(eps, 4) ORDER BY percentile) = 1"""
SQL["slice_grid"] = sql("""
  SELECT b.branch, feature_set, space, b.n AS n_rows, true AS sound
  FROM (SELECT 'hourly' AS branch, count(*) AS n FROM weekly UNION ALL SELECT 'daily', count(*) FROM branch_b) b,
    (SELECT unnest(['ratios', 'absolute', 'absolute_no_count']) AS feature_set), (SELECT unnest(['scaled', 'pca']) AS space)""")
SQL["base_clusters"] = """
  SELECT 'hourly' AS branch, 'ratios' AS feature_set, 'scaled' AS space, algorithm, k::INT AS k, k::BIGINT AS n_clusters, 0::BIGINT AS n_noise, true AS scored, 1::BIGINT AS n_best
  FROM (SELECT unnest(['kmeans', 'agglomerative', 'gmm']) AS algorithm), (SELECT unnest([2, 3, 4]) AS k)"""
SQL["global_summary"] = """
  SELECT unnest(['hourly', 'daily']) AS branch, feature_set, 'pca' AS space, true AS sound
  FROM (SELECT unnest(['ratios', 'absolute', 'absolute_no_count']) AS feature_set)"""

# --- readers and writers -------------------------------------------------------------
SQL["branch_features"] = sql(f"""SELECT dataset, system, resolution, scale_type, entity_id, window_start, n_records, n_missing,
  CASE WHEN dataset <> 'FURNITURE' THEN anomaly_count END AS anomaly_count, {rs(*[f for f in feature_list() if f != 'anomaly_rate'])},
  CASE WHEN dataset <> 'FURNITURE' THEN round(anomaly_rate, 6) + 0.0 END AS anomaly_rate FROM weekly""")
SQL["source_audit"] = f"""SELECT dataset, rows, entities, frequency, median_records, mean_sum_activity, median_sum_activity, classification
  FROM ({SQL["profile"]}) JOIN ({SQL["classify_resolution"]}) USING (dataset)"""
SQL["activity_round_trip"] = sql(f"SELECT dataset, system, entity_id, ts, {rs('eat', 'rest')}, anomaly_label FROM clean")
SQL["event_log_round_trip"] = sql("SELECT * FROM log WHERE event_type <> 'BIRTH'")
SQL["feature_tables_round_trip"] = SQL["branch_union"]
SQL["summary_round_trip"] = sql(f"""
  SELECT count(*) AS rows, {9 + len(feature_list())} AS columns, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, count(DISTINCT entity_id) AS entities,
    CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in feature_list() + ['anomaly_count'])}) AS BIGINT) AS missing FROM weekly""")
SQL["slice_round_trip"] = sql("""
  SELECT 'hourly' AS branch, feature_set, (SELECT count(*) FROM weekly) AS n_rows, true AS later, true AS began_empty
  FROM (SELECT unnest(['ratios', 'absolute']) AS feature_set)""")
SQL["rows_with_time"] = f"""
  SELECT CAST(user_id AS VARCHAR) AS entity_id, count(*) AS n, {r('sum(value)', 'eat')} FROM events WHERE event_type <> 'signup' GROUP BY 1"""
