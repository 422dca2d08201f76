"""The same results in plain SQL, written independently, for the check in DuckDB."""

from __future__ import annotations

from batchgauge.plans.bindings import ROWS_PER_FILE, SENSORS

ORACLES: dict[str, str] = {}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def _readings(condition: str, name: str = "readings") -> str:
    return f"""{name} AS (
  SELECT strftime(ts, '%Y-%m-%d') AS batch_id, event_id AS row_number, ts, event_type AS sensor,
         CASE WHEN {condition} THEN NULL ELSE value END AS value
  FROM events)"""


SCATTERED = _readings("event_id % 7 = 0")
LONG = _readings("event_id % 150 < 50")
DAYS = "days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS batch_id FROM events)"


def _neighbours(source: str, name: str = "near") -> str:
    return f"""{name}_pos AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, sensor ORDER BY ts, row_number) AS pos FROM {source}),
{name} AS (
  SELECT *, last_value(value IGNORE NULLS) OVER p AS pv,
         last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pp,
         first_value(value IGNORE NULLS) OVER n AS nv,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS np
  FROM {name}_pos
  WINDOW p AS (PARTITION BY batch_id, sensor ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY batch_id, sensor ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _line(limit: str) -> str:
    return f"""CASE WHEN value IS NOT NULL THEN value
         WHEN pos - pp <= {limit} OR np - pos <= {limit} THEN
           CASE WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv
                ELSE pv + (nv - pv) * ((pos - pp) / (np - pp)) END END"""


def _interpolated(source: str, limit: int, name: str = "imputed", near: str = "near") -> str:
    return f"""{_neighbours(source, near)},
{name} AS (SELECT batch_id, row_number, ts, sensor, coalesce({_line(str(limit))}, 0.0) AS value FROM {near})"""


def _stats(source: str, name: str = "stats", keys: str = "batch_id, sensor") -> str:
    return f"""{name} AS (
  SELECT {keys}, count(value) AS "count", avg(value) AS mean,
         coalesce(stddev_samp(value), 0.0) AS std, min(value) AS "min", max(value) AS "max",
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, max(value) - min(value) AS "range"
  FROM {source} GROUP BY {keys} HAVING count(value) > 0)"""


def _long_metrics(stats: str = "stats", name: str = "metrics") -> str:
    parts = " UNION ALL ".join(
        f"SELECT batch_id, sensor, '{m}' AS metric_name, CAST(\"{m}\" AS DOUBLE) AS metric_value FROM {stats}"
        for m in ("mean", "std", "min", "max", "median", "range", "count")
    )
    return f"{name} AS ({parts})"


METRICS = (SCATTERED, _interpolated("readings", 5), _stats("imputed"), _long_metrics())

DAY_CONFIG = """config AS (
  SELECT batch_id,
         CASE d % 4 WHEN 0 THEN 'interpolate' WHEN 1 THEN 'fill' WHEN 2 THEN 'drop' ELSE 'ffill' END AS strategy,
         CAST(d % 3 AS DOUBLE) AS fill_value, d % 3 + 2 AS gap,
         CASE WHEN d % 2 = 0 THEN 'zscore' ELSE 'iqr' END AS method,
         CASE d % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 3.0 ELSE 3.5 END AS zt,
         CASE d % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 3.0 END AS im,
         d % 5 <> 0 AS f_mean, d % 2 = 0 AS f_median, d % 3 = 0 AS f_range
  FROM (SELECT batch_id, day(CAST(batch_id AS DATE)) AS d FROM days))"""


def _by_config(source: str) -> str:
    return f"""{_neighbours(source)},
imputed AS (
  SELECT n.batch_id, row_number, ts, sensor,
         CASE strategy WHEN 'interpolate' THEN coalesce({_line('gap')}, fill_value)
              WHEN 'fill' THEN coalesce(value, fill_value)
              WHEN 'ffill' THEN coalesce(pv, nv, fill_value) ELSE value END AS value
  FROM near n JOIN config c ON n.batch_id = c.batch_id
  WHERE NOT (strategy = 'drop' AND value IS NULL))"""


CONFIGURED = (SCATTERED, DAYS, DAY_CONFIG, _by_config("readings"), _stats("imputed"))
ANOMALIES_BY_CONFIG = """anomalies AS (
  SELECT i.batch_id, i.sensor, row_number, ts, value, method,
         CASE WHEN method = 'zscore' THEN abs((value - mean) / std) END AS score,
         CASE WHEN method = 'iqr' THEN q1 - im * (q3 - q1) END AS lower,
         CASE WHEN method = 'iqr' THEN q3 + im * (q3 - q1) END AS upper,
         CASE WHEN method = 'iqr' THEN CASE WHEN value < q1 - im * (q3 - q1) THEN 'below_lower'
                                            WHEN value > q3 + im * (q3 - q1) THEN 'above_upper' END END AS side
  FROM imputed i JOIN stats s ON i.batch_id = s.batch_id AND i.sensor = s.sensor
  JOIN config c ON c.batch_id = i.batch_id
  WHERE s."count" >= 5 AND value IS NOT NULL AND CASE WHEN method = 'zscore'
    THEN std > 0 AND abs((value - mean) / nullif(std, 0)) > zt
    ELSE value < q1 - im * (q3 - q1) OR value > q3 + im * (q3 - q1) END)"""


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


# --- sources and validation ---------------------------------------------------------

CSV_FIELDS = """fields AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, ts,
         CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 79 = 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
              WHEN event_id % 73 = 0 THEN 't' || strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS t,
         CASE WHEN event_id % 83 = 0 THEN 'n/a' WHEN event_id % 71 = 0 THEN ' '
              ELSE CAST(value AS VARCHAR) END AS v,
         CAST(user_id AS VARCHAR) AS u, event_id % 89 = 0 AS wide,
         CASE WHEN event_id % 79 = 0 THEN date_trunc('second', ts) ELSE ts END AS parsed,
         CASE WHEN event_id % 89 = 0 THEN 'column_mismatch' WHEN event_id % 97 = 0 THEN 'missing_timestamp'
              WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN 'invalid_timestamp' END AS kind,
         CASE WHEN event_id % 83 = 0 OR event_id % 71 = 0 THEN NULL ELSE value END AS num,
         CAST(user_id AS DOUBLE) AS unum
  FROM events),
lines AS (SELECT *, t || ',' || v || ',' || u || CASE WHEN wide THEN ',x' ELSE '' END AS line FROM fields),
errors AS (
  SELECT day AS batch_id, event_id + 2 AS row_number, kind AS error_type,
         CASE kind WHEN 'column_mismatch' THEN 'expected 3 columns, found 4'
                   WHEN 'missing_timestamp' THEN 'timestamp is blank'
                   ELSE 'cannot read timestamp ''' || t || '''' END AS error_detail,
         line AS raw_data
  FROM lines WHERE kind IS NOT NULL
  UNION ALL
  SELECT day, event_id + 2, 'non_numeric_value', 'value of sensor value is not a number: ''n/a''', line
  FROM lines WHERE kind IS NULL AND event_id % 83 = 0),
cells AS (
  SELECT day AS batch_id, event_id + 2 AS row_number, parsed AS ts, 'value' AS sensor, num AS value
  FROM fields WHERE kind IS NULL
  UNION ALL
  SELECT day, event_id + 2, parsed, 'user_id', unum FROM fields WHERE kind IS NULL)"""

ORACLES["csv_scan"] = _with(CSV_FIELDS) + f"""
, numbered AS (
  SELECT *, strftime(ts, '%Y%m%d') || '/' || CAST(event_id // {ROWS_PER_FILE} AS VARCHAR) AS batch_id,
         row_number() OVER (PARTITION BY day, event_id // {ROWS_PER_FILE} ORDER BY event_id) + 1 AS line_number
  FROM fields)
SELECT batch_id, line_number AS row_number, parsed AS ts, 'value' AS sensor, num AS value FROM numbered WHERE kind IS NULL
UNION ALL
SELECT batch_id, line_number, parsed, 'user_id', unum FROM numbered WHERE kind IS NULL"""

ORACLES["file_contract"] = """
SELECT CAST(user_id AS VARCHAR) AS batch_id,
       CASE WHEN user_id % 19 = 0 THEN 'empty_file'
            WHEN user_id % 7 = 0 THEN 'missing_timestamp_column'
            WHEN user_id % 11 = 0 THEN 'no_sensor_column'
            WHEN user_id % 13 = 0 THEN 'duplicate_column'
            ELSE 'no_valid_rows' END AS reason
FROM (SELECT DISTINCT user_id FROM events)
WHERE user_id % 19 = 0 OR user_id % 7 = 0 OR user_id % 11 = 0 OR user_id % 13 = 0 OR user_id % 17 = 0"""

GRID = """hours AS (
  SELECT strftime(ts, '%Y-%m-%d') AS batch_id, hour(ts) AS h, date_trunc('hour', ts) AS ts, event_type AS sensor,
         arg_min(value, event_id) AS value
  FROM events GROUP BY ALL),
grid AS (
  SELECT r.batch_id, CAST(r.h + 2 AS BIGINT) AS row_number, r.ts, s.sensor, v.value
  FROM (SELECT DISTINCT batch_id, h, ts FROM hours) r
  CROSS JOIN (VALUES {types}) s(sensor)
  LEFT JOIN hours v ON v.batch_id = r.batch_id AND v.h = r.h AND v.sensor = s.sensor)""".format(
    types=", ".join(f"('{s}')" for s in SENSORS)
)
ORACLES["wide_to_long"] = _with(GRID) + "SELECT * FROM grid"
ORACLES["long_to_wide"] = _with(GRID) + "SELECT batch_id, row_number, ts, {} FROM grid GROUP BY 1, 2, 3".format(
    ", ".join(f"max(CASE WHEN sensor = '{s}' THEN value END) AS \"{s}\"" for s in SENSORS))
ORACLES["dedup_rows"] = _with(GRID) + """
, halves AS (SELECT *, ts - to_hours(CAST(hour(ts) % 12 AS INTEGER)) AS t FROM grid),
first_rows AS (SELECT batch_id, t, min(row_number) AS row_number FROM halves GROUP BY 1, 2)
SELECT batch_id, row_number, t AS ts, {} FROM halves JOIN first_rows USING (batch_id, t, row_number) GROUP BY 1, 2, 3""".format(
    ", ".join(f"max(CASE WHEN sensor = '{s}' THEN value END) AS \"{s}\"" for s in SENSORS))
ORACLES["lenient_times"] = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%Y%m%d')
         WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y/%-m/%-d') WHEN 4 THEN strftime(ts, '%Y%m%dT%H%M%S')
         WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END AS text,
       CASE WHEN event_id % 7 = 5 THEN date_trunc('second', ts) END AS strict,
       CASE event_id % 7 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
         WHEN 3 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) WHEN 6 THEN NULL ELSE date_trunc('second', ts) END AS lenient
FROM events"""
for kind in ("column_mismatch", "missing_timestamp", "invalid_timestamp"):
    ORACLES[f"err_{kind}"] = _with(CSV_FIELDS) + f"SELECT * FROM errors WHERE error_type = '{kind}'"
ORACLES["err_non_numeric"] = _with(CSV_FIELDS) + "SELECT * FROM errors WHERE error_type = 'non_numeric_value'"
ORACLES["row_errors"] = _with(CSV_FIELDS) + "SELECT * FROM errors"
ORACLES["clean_readings"] = _with(CSV_FIELDS) + "SELECT * FROM cells"
ORACLES["run_counters"] = _with(CSV_FIELDS) + """
SELECT p.batch_id, rows_processed, coalesce(error_records, 0) AS error_records, coalesce(error_rows, 0) AS error_rows
FROM (SELECT batch_id, count(DISTINCT ts) AS rows_processed FROM cells GROUP BY 1) p
LEFT JOIN (SELECT batch_id, count(*) AS error_records, count(DISTINCT row_number) AS error_rows FROM errors GROUP BY 1) e
ON p.batch_id = e.batch_id"""
ORACLES["source_summary"] = _with(CSV_FIELDS) + """
SELECT p.batch_id, total_rows, total_cells, sensor_columns, columns, time_start, time_end, coalesce(n, 0) AS error_records
FROM (SELECT batch_id, count(DISTINCT row_number) AS total_rows, count(*) AS total_cells,
             count(DISTINCT sensor) AS sensor_columns, string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS columns, min(ts) AS time_start, max(ts) AS time_end
      FROM cells GROUP BY 1) p
LEFT JOIN (SELECT batch_id, count(*) AS n FROM errors GROUP BY 1) e ON p.batch_id = e.batch_id"""
ORACLES["error_type_counts"] = _with(CSV_FIELDS) + (
    "SELECT batch_id, error_type, count(*) AS errors FROM errors GROUP BY 1, 2"
)
ORACLES["source_column_stats"] = _with(SCATTERED) + f"""
SELECT batch_id, sensor, "count", null_count, {_r("mean", "std", "min", "max", "median")} FROM (
  SELECT batch_id, sensor, count(value) AS "count", count(*) - count(value) AS null_count, avg(value) AS mean,
         coalesce(stddev_samp(value), 0.0) AS std, min(value) AS "min", max(value) AS "max", median(value) AS median
  FROM readings GROUP BY 1, 2)"""

# --- cleaning and imputation --------------------------------------------------------

ORACLES["dedup_readings"] = _with(SCATTERED) + """
SELECT batch_id, row_number, t AS ts, sensor, value FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, sensor, t ORDER BY row_number) AS nth
  FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS t FROM readings)) WHERE nth = 1"""
ORACLES["impute_interpolate"] = _with(LONG, _interpolated("readings", 3)) + (
    f"SELECT batch_id, row_number, ts, sensor, {_r('value')} FROM imputed"
)
ORACLES["impute_interpolate_sliced"] = ORACLES["impute_interpolate"]
ORACLES["impute_fill"] = _with(SCATTERED) + (
    "SELECT batch_id, row_number, ts, sensor, coalesce(value, 1.5) AS value FROM readings"
)
ORACLES["impute_drop"] = _with(GRID) + """
SELECT * FROM grid WHERE (batch_id, row_number) NOT IN (SELECT (batch_id, row_number) FROM grid WHERE value IS NULL)"""
ORACLES["impute_ffill"] = _with(LONG, _neighbours("readings")) + (
    "SELECT batch_id, row_number, ts, sensor, coalesce(pv, nv, 0.0) AS value FROM near"
)
ORACLES["impute_by_config"] = _with(LONG, DAYS, DAY_CONFIG, _by_config("readings")) + (
    f"SELECT batch_id, row_number, ts, sensor, {_r('value')} FROM imputed"
)

# --- metrics and anomalies ----------------------------------------------------------

ORACLES["sensor_metrics"] = _with(*METRICS) + (
    f"SELECT batch_id, sensor, metric_name, {_r('metric_value')} FROM metrics"
)
ORACLES["sensor_metrics_sliced"] = ORACLES["sensor_metrics"]
ORACLES["lineitem_metrics"] = _with("""
line_readings AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS batch_id, l_returnflag || l_linestatus || '_quantity' AS sensor,
         l_quantity AS value FROM lineitem
  UNION ALL
  SELECT CAST(year(l_shipdate) AS VARCHAR), l_returnflag || l_linestatus || '_price', l_extendedprice FROM lineitem)""",
    _stats("line_readings"), _long_metrics()) + (
    f"SELECT batch_id, sensor, metric_name, {_r('metric_value', digits=4)} FROM metrics"
)
ORACLES["metrics_by_config"] = _with(*CONFIGURED, _long_metrics()) + f"""
SELECT m.batch_id, sensor, metric_name, {_r('metric_value')} FROM metrics m JOIN config c ON m.batch_id = c.batch_id
WHERE CASE metric_name WHEN 'mean' THEN f_mean WHEN 'median' THEN f_median WHEN 'range' THEN f_range ELSE true END"""
ORACLES["anomaly_zscore"] = _with(SCATTERED, _stats("readings")) + """
SELECT r.batch_id, r.sensor, row_number, ts, value, round(abs((value - mean) / std), 6) AS score
FROM readings r JOIN stats s ON r.batch_id = s.batch_id AND r.sensor = s.sensor
WHERE s."count" >= 5 AND std > 0 AND abs((value - mean) / std) > 3.0"""
ORACLES["anomaly_labels"] = _with(SCATTERED, _stats("readings")) + """
SELECT r.batch_id, r.sensor, row_number, printf('zscore (z=%.2f)', abs((value - mean) / std)) AS label
FROM readings r JOIN stats s ON r.batch_id = s.batch_id AND r.sensor = s.sensor
WHERE s."count" >= 5 AND std > 0 AND abs((value - mean) / std) > 3.0"""
ORACLES["anomaly_iqr"] = _with(SCATTERED, _stats("readings")) + """
, fenced AS (
  SELECT r.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM readings r JOIN stats s ON r.batch_id = s.batch_id AND r.sensor = s.sensor WHERE s."count" >= 5)
SELECT batch_id, sensor, row_number, ts, value, round(lo, 6) AS lower, round(hi, 6) AS upper,
       CASE WHEN value < lo THEN 'below_lower' ELSE 'above_upper' END AS side
FROM fenced WHERE value < lo OR value > hi"""
ORACLES["anomaly_by_config"] = _with(*CONFIGURED, ANOMALIES_BY_CONFIG) + f"""
SELECT batch_id, sensor, row_number, ts, {_r("value")}, method, {_r("score", "lower", "upper")}, side FROM anomalies"""
ORACLES["anomaly_by_config_sliced"] = ORACLES["anomaly_by_config"]
ORACLES["anomaly_kind_counts"] = _with(*CONFIGURED, ANOMALIES_BY_CONFIG) + (
    "SELECT batch_id, method, side, count(*) AS anomalies FROM anomalies GROUP BY 1, 2, 3"
)
SCORES = """scores AS (
  SELECT r.batch_id, r.sensor, abs((value - mean) / std) AS z
  FROM readings r JOIN stats s ON r.batch_id = s.batch_id AND r.sensor = s.sensor
  WHERE s."count" >= 5 AND std > 0 AND value IS NOT NULL)"""
ORACLES["zscore_threshold_sweep"] = _with(SCATTERED, _stats("readings"), SCORES) + """
SELECT b.batch_id, CAST(t.threshold AS DOUBLE) AS threshold, count(z) AS anomalies
FROM (SELECT DISTINCT batch_id FROM stats) b CROSS JOIN (VALUES (1.0), (1.5), (2.0), (3.0)) t(threshold)
LEFT JOIN scores s ON s.batch_id = b.batch_id AND s.z > t.threshold GROUP BY 1, 2"""
COUNTS = """counts AS (
  SELECT batch_id, sensor, count(*) AS anomalies FROM scores WHERE z > 3.0 GROUP BY 1, 2),
totals AS (
  SELECT d.batch_id, count(s.z) AS total FROM days d LEFT JOIN scores s ON s.batch_id = d.batch_id AND s.z > 3.0
  GROUP BY 1)"""
COUNTED = (SCATTERED, DAYS, _stats("readings"), SCORES, COUNTS)
ORACLES["anomaly_counts"] = _with(*COUNTED) + """
SELECT batch_id, sensor, anomalies FROM counts UNION ALL SELECT batch_id, NULL, total FROM totals"""
ORACLES["anomaly_range"] = _with(*COUNTED) + """
SELECT min(total) AS min_total, max(total) AS max_total, max(total) - min(total) AS abs_diff,
       (SELECT count(DISTINCT sensor) FROM counts) AS sensors FROM totals"""

# --- comparison ---------------------------------------------------------------------

MATRIX = """matrix AS (
  SELECT sensor, metric_name, count(*) AS batches, min(metric_value) AS min_value, max(metric_value) AS max_value,
         CASE WHEN count(*) >= 2 THEN max(metric_value) - min(metric_value) END AS abs_diff,
         CASE WHEN count(*) >= 2 AND min(metric_value) <> 0
              THEN (max(metric_value) - min(metric_value)) / abs(min(metric_value)) * 100 END AS rel_diff_pct
  FROM metrics GROUP BY 1, 2)"""
MATRIX_COLUMNS = "sensor, metric_name, batches, " + _r("min_value", "max_value", "abs_diff", "rel_diff_pct")
ORACLES["cmp_metrics"] = _with(*METRICS, MATRIX) + f"SELECT {MATRIX_COLUMNS} FROM matrix"
DAY_NAMES = [f"2024-01-{d:02d}" for d in range(1, 31)]
ORACLES["cmp_metrics_wide"] = _with(*METRICS, MATRIX) + """
SELECT m.sensor, m.metric_name, {values}, round(any_value(x.abs_diff), 6) AS abs_diff,
       round(any_value(x.rel_diff_pct), 6) AS rel_diff_pct
FROM metrics m JOIN matrix x ON m.sensor = x.sensor AND m.metric_name = x.metric_name GROUP BY 1, 2""".format(
    values=", ".join(
        f"round(max(CASE WHEN batch_id = '{d}' THEN metric_value END), 6) AS \"value_{d}\"" for d in DAY_NAMES
    )
)
ORACLES["cmp_summary"] = _with(*METRICS, MATRIX) + """
SELECT count(*) AS total_metrics_compared, count(*) FILTER (abs_diff > 0) AS metrics_with_diff FROM matrix"""
ORACLES["cmp_top10"] = _with(*METRICS, MATRIX) + f"""
SELECT {MATRIX_COLUMNS} FROM (
  SELECT * FROM matrix WHERE abs_diff > 0 ORDER BY abs_diff DESC, sensor, metric_name LIMIT 10)"""
ORACLES["cmp_anomalies_wide"] = _with(*COUNTED) + """
SELECT t.batch_id, any_value(total) AS total_anomalies, {values}
FROM totals t LEFT JOIN counts c ON c.batch_id = t.batch_id GROUP BY 1""".format(
    values=", ".join(
        f"coalesce(max(CASE WHEN sensor = '{s}' THEN anomalies END), 0) AS \"anomalies_{s}\"" for s in SENSORS
    )
)

RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS batch_id,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'pending' END AS run_status,
         CAST(o_orderpriority[1] AS INTEGER) AS config_version,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS rows_processed, o_orderkey % 7 AS rows_errors,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run_number
  FROM orders),
latest AS (SELECT * FROM runs WHERE run_id IN (SELECT max(run_id) FROM runs GROUP BY batch_id))"""
RUN_METRICS = """line_stats AS (
  SELECT l_orderkey AS run_id, avg(l_quantity) AS qa, max(l_quantity) AS qx, count(l_quantity) AS qc,
         avg(l_extendedprice) AS pa, max(l_extendedprice) AS px, count(l_extendedprice) AS pc
  FROM lineitem GROUP BY 1),
run_metrics AS (
  SELECT run_id, 'quantity' AS sensor, 'mean' AS metric_name, qa AS metric_value FROM line_stats
  UNION ALL SELECT run_id, 'quantity', 'max', qx FROM line_stats
  UNION ALL SELECT run_id, 'quantity', 'count', CAST(qc AS DOUBLE) FROM line_stats
  UNION ALL SELECT run_id, 'price', 'mean', pa FROM line_stats
  UNION ALL SELECT run_id, 'price', 'max', px FROM line_stats
  UNION ALL SELECT run_id, 'price', 'count', CAST(pc AS DOUBLE) FROM line_stats)"""
RUN_ANOMALIES = """run_anomalies AS (
  SELECT l_orderkey AS run_id, 'quantity' AS sensor, CAST(l_linenumber AS BIGINT) AS row_number,
         l_shipdate AS "timestamp", l_quantity AS value, 'iqr' AS anomaly_type
  FROM lineitem)"""
RUN_ERRORS = """run_errors AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS row_number,
         CASE l_returnflag WHEN 'A' THEN 'column_mismatch' WHEN 'N' THEN 'missing_timestamp'
              ELSE 'non_numeric_value' END AS error_type,
         l_linestatus AS error_detail, CAST(l_partkey AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) AS raw_data
  FROM lineitem)"""
BATCHES = """batches AS (
  SELECT c_custkey AS batch_id, c_name AS batch_name, c_nationkey % 5 = 0 AS locked, 1 + c_custkey % 4 AS config_version,
         c_name || '.csv' AS source_file,
         '{"version": ' || CAST(1 + c_custkey % 4 AS VARCHAR) ||
         ', "cleaning": {"remove_duplicates": true}, "missing_values": {"strategy": "fill"}' ||
         ', "metrics": {"compute_mean": true}, "anomaly_detection": {"zscore_threshold": ' ||
         CAST(c_nationkey % 3 + 1 AS VARCHAR) || '}}' AS config_json
  FROM customer)"""
ORACLES["metric_key_union"] = _with(*METRICS, RUN_METRICS) + """
SELECT sensor, metric_name FROM metrics UNION SELECT sensor, metric_name FROM run_metrics"""
ORACLES["batch_summaries"] = _with(RUNS, RUN_METRICS, RUN_ANOMALIES, BATCHES) + """
SELECT b.batch_id, batch_name, 'processed' AS status, locked, source_file, l.config_version, l.run_id, run_number,
       rows_processed, rows_errors, coalesce(a.n, 0) AS anomalies_count, coalesce(m.n, 0) AS metrics_count,
       CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS VARCHAR) AS processed_at
FROM batches b JOIN latest l ON b.batch_id = l.batch_id JOIN orders ON o_orderkey = l.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_anomalies GROUP BY 1) a ON a.run_id = l.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_metrics GROUP BY 1) m ON m.run_id = l.run_id"""

ORACLES["cmp_metrics_blocks"] = _with(*METRICS) + """
, placed AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) - 1 AS p FROM (SELECT DISTINCT batch_id FROM metrics))
SELECT CAST(p // 7 AS INTEGER) AS block, sensor, metric_name, {values}
FROM metrics JOIN placed USING (batch_id) GROUP BY 1, 2, 3""".format(
    values=", ".join(f"round(max(CASE WHEN p % 7 = {i} THEN metric_value END), 6) AS c{i}" for i in range(7)))
ORACLES["cmp_document"] = _with(
    *METRICS, MATRIX, DAYS, _stats("readings", "raw_stats"), SCORES.replace("JOIN stats", "JOIN raw_stats"), COUNTS) + """
, named AS (
  SELECT batch_id, batch_id || ':day ' || batch_id AS label, day(CAST(batch_id AS DATE)) % 2 = 0 AS locked,
         CASE WHEN batch_id = (SELECT min(batch_id) FROM days) THEN '' ELSE ',' END AS comma FROM days),
keyed AS (
  SELECT sensor || '::' || metric_name AS metric, sensor, metric_name, abs_diff, rel_diff_pct,
         (SELECT min(batch_id) FROM metrics m WHERE m.sensor = x.sensor AND m.metric_name = x.metric_name) AS first_batch FROM matrix x)
SELECT '{"name":"days","scheme":{"id":#,"name":"s","version":"1.0"},"generated_at":"2025-01-01T00:00:00","batch_summaries":[' AS line,
       CAST(7 AS DOUBLE) AS numbers
UNION ALL SELECT comma || '{"batch_id":"' || batch_id || '","batch_name":"day ' || batch_id || '","locked":' || CAST(locked AS VARCHAR) || '}', 0 FROM named
UNION ALL SELECT '],"metrics_diff":{"summary":{"total_metrics_compared":#,"metrics_with_diff":#,"batch_keys":[',
                 count(*) + count(*) FILTER (abs_diff > 0) FROM matrix
UNION ALL SELECT comma || '"' || label || '"', 0 FROM named
UNION ALL SELECT ']},"per_metric":{', 0
UNION ALL SELECT CASE WHEN metric = (SELECT min(metric) FROM keyed) THEN '' ELSE ',' END || '"' || metric || '":{"sensor":"' || sensor
                 || '","metric":"' || metric_name || '","values":{', 0 FROM keyed
UNION ALL SELECT CASE WHEN m.batch_id = first_batch THEN '' ELSE ',' END || '"' || label || '":#', round(metric_value, 5)
          FROM metrics m JOIN keyed k ON k.sensor = m.sensor AND k.metric_name = m.metric_name JOIN named n ON n.batch_id = m.batch_id
UNION ALL SELECT '},"abs_diff":' || CASE WHEN abs_diff IS NULL THEN 'null' ELSE '#' END || ',"rel_diff_pct":'
                 || CASE WHEN rel_diff_pct IS NULL THEN 'null' ELSE '#' END || '}',
                 round(coalesce(abs_diff, 0) + coalesce(rel_diff_pct, 0), 5) FROM keyed
UNION ALL SELECT '}},"anomalies_diff":{"per_batch":{', 0
UNION ALL SELECT comma || '"' || label || '":{"total":#,"locked":' || CAST(locked AS VARCHAR) || ',"per_sensor":{', total
          FROM totals JOIN named USING (batch_id)
UNION ALL SELECT CASE WHEN sensor = min(sensor) OVER (PARTITION BY batch_id) THEN '' ELSE ',' END || '"' || sensor || '":#', anomalies FROM counts
UNION ALL SELECT '}}', 0 FROM named
UNION ALL SELECT '},"total_anomalies_range":{"min":#,"max":#,"abs_diff":#},"sensors_with_anomalies":[', 2 * max(total) FROM totals
UNION ALL SELECT CASE WHEN sensor = (SELECT min(sensor) FROM counts) THEN '' ELSE ',' END || '"' || sensor || '"', 0
          FROM (SELECT DISTINCT sensor FROM counts)
UNION ALL SELECT ']}}', 0"""
ORACLES["sketch_errors"] = _with(SCATTERED) + """
SELECT batch_id, sensor, count(value) AS n, true AS q1_within, true AS median_within, true AS q3_within
FROM readings GROUP BY 1, 2 HAVING count(value) > 0"""
ORACLES["fingerprint_tree"] = _with(CSV_FIELDS) + """
, files AS (
  SELECT strftime(ts, '%Y%m%d') AS day, event_id // 1000000 AS part, line, row_number() OVER (
    PARTITION BY strftime(ts, '%Y%m%d'), event_id // 1000000 ORDER BY event_id) AS n
  FROM lines JOIN (SELECT event_id AS id FROM events) ON id = event_id
  UNION ALL SELECT DISTINCT strftime(ts, '%Y%m%d'), event_id // 1000000, 'timestamp,value,user_id', 0 FROM events),
leaves AS (
  SELECT day, part, n // 100 AS block, count(*) AS lines, sum(strlen(line) + 1) AS size, sha256(string_agg(sha256(line), '' ORDER BY n)) AS digest
  FROM files GROUP BY 1, 2, 3),
nodes AS (
  SELECT day, part, block // 10000 AS node, sum(lines) AS lines, sum(size) AS size, sha256(string_agg(digest, '' ORDER BY block)) AS digest
  FROM leaves GROUP BY 1, 2, 3)
SELECT day, CAST(sum(size) AS BIGINT) AS file_size, CAST(sum(lines) AS BIGINT) AS lines,
       sha256('100:' || CAST(sum(size) AS VARCHAR) || ':' || sha256(string_agg(digest, '' ORDER BY node))) AS tree_sha256
FROM nodes GROUP BY day, part"""

# --- drift --------------------------------------------------------------------------

DRIFT = """first_day AS (SELECT min(batch_id) AS batch_id FROM metrics),
base AS (SELECT sensor, metric_name, metric_value AS b FROM metrics WHERE batch_id IN (SELECT batch_id FROM first_day)),
pairs AS (
  SELECT m.batch_id, m.sensor, m.metric_name, b, metric_value AS a, metric_value - b AS d,
         CASE WHEN b = 0 THEN CASE WHEN metric_value = 0 THEN 0.0 ELSE 100.0 END
              ELSE (metric_value - b) / abs(b) * 100 END AS r
  FROM metrics m JOIN base x ON m.sensor = x.sensor AND m.metric_name = x.metric_name
  WHERE m.batch_id NOT IN (SELECT batch_id FROM first_day)),
drift AS (SELECT *, CASE WHEN abs(r) <= 5 THEN 'pass' WHEN abs(r) <= 15 THEN 'warn' ELSE 'block' END AS status FROM pairs),
verdict AS (
  SELECT CAST(1 AS BIGINT) AS baseline_id, batch_id, count(*) AS total_metrics,
         count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'warn') AS warn_count,
         count(*) FILTER (status = 'block') AS block_count,
         CASE WHEN bool_or(status = 'block') THEN 'block' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS check_status
  FROM drift GROUP BY batch_id)"""
ORACLES["baseline_thresholds"] = _with(*METRICS) + """
SELECT batch_id, sensor, metric_name, round(b, 7) AS baseline_value, 5.0::DOUBLE AS warn_pct, 15.0::DOUBLE AS block_pct,
       round(b - w, 7) AS warn_min, round(b + w, 7) AS warn_max, round(b - k, 7) AS block_min, round(b + k, 7) AS block_max
FROM (SELECT *, metric_value AS b, CASE WHEN metric_value = 0 THEN 0.01 ELSE abs(metric_value) * 0.05 END AS w,
             CASE WHEN metric_value = 0 THEN 0.1 ELSE abs(metric_value) * 0.15 END AS k FROM metrics)"""
ORACLES["drift_check"] = _with(*METRICS, DRIFT) + """
SELECT CAST(1 AS BIGINT) AS baseline_id, batch_id, sensor, metric_name, round(b, 6) AS baseline_value,
       round(a, 6) AS actual_value, round(d, 6) AS absolute_diff, round(r, 6) AS relative_pct,
       5.0::DOUBLE AS warn_pct, 15.0::DOUBLE AS block_pct, status FROM drift"""
ORACLES["drift_check_by_name"] = _with(*METRICS, DRIFT) + """
SELECT CAST(1 AS BIGINT) AS baseline_id, batch_id, metric_name, round(b, 6) AS baseline_value,
       round(a, 6) AS actual_value, round(d, 6) AS absolute_diff, round(r, 6) AS relative_pct, status
FROM drift WHERE sensor = (SELECT max(sensor) FROM metrics)"""
ORACLES["drift_overall"] = _with(*METRICS, DRIFT) + """
SELECT *, CASE check_status WHEN 'block' THEN 'stop and investigate' WHEN 'warn' THEN 'review before going on'
               ELSE 'go on' END AS recommended_action FROM verdict"""
ORACLES["baseline_eligible"] = _with("""
requests AS (
  SELECT o_orderkey AS request_id, 'base_' || CAST(o_custkey % 500 AS VARCHAR) AS name, o_custkey AS batch_id,
         CASE WHEN o_orderstatus = 'O' THEN (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey)
              WHEN o_orderpriority = '5-LOW' THEN o_orderkey + 1 ELSE o_orderkey END AS run_id
  FROM orders o),
judged AS (
  SELECT q.*, CASE WHEN r.o_custkey IS NULL OR r.o_custkey <> q.batch_id THEN 'run_not_of_batch'
                   WHEN r.o_orderstatus <> 'F' THEN 'run_not_successful'
                   WHEN q.name IN (SELECT 'base_' || CAST(c_custkey * 5 AS VARCHAR) FROM customer)
                   THEN 'name_exists' END AS reason
  FROM requests q LEFT JOIN orders r ON r.o_orderkey = q.run_id)""") + """
SELECT request_id, name, batch_id, run_id,
       CASE WHEN reason IS NULL AND request_id <> min(CASE WHEN reason IS NULL THEN request_id END) OVER (PARTITION BY name)
            THEN 'name_exists' ELSE reason END AS reason FROM judged"""
ORACLES["baseline_last_check"] = """
SELECT o_orderkey AS id, o_custkey AS baseline_id,
       CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warn' ELSE 'block' END AS check_status
FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)"""
ORACLES["raise_tickets"] = _with(SCATTERED, DAYS, _interpolated("readings", 5), _stats("imputed", "istats"),
                                 _long_metrics("istats"), DRIFT, _stats("readings"), SCORES, COUNTS) + """
, raised AS (
  SELECT batch_id, 'baseline_blocked' AS trigger_rule FROM verdict
  WHERE check_status = 'block' AND day(CAST(batch_id AS DATE)) % 3 <> 0
  UNION ALL SELECT batch_id, 'too_many_anomalies' FROM totals WHERE total > 4)
SELECT *, trigger_rule || ': ' || batch_id AS title FROM raised"""

# --- replay -------------------------------------------------------------------------

REPLAY = (
    LONG, _interpolated("readings", 3, "filled_a", "near_a"),
    _neighbours("readings", "near_b"),
    "filled_b AS (SELECT batch_id, sensor, coalesce(pv, nv, 0.0) AS value FROM near_b)",
    _stats("filled_a", "stats_a"), _long_metrics("stats_a", "metrics_a"),
    _stats("filled_b", "stats_b"), _long_metrics("stats_b", "all_b"),
    "metrics_b AS (SELECT * FROM all_b WHERE metric_name <> 'range')",
    """compared AS (
  SELECT *, coalesce(rel_diff_pct <= 5.0, false) AS within_tolerance,
         original_value IS NULL OR new_value IS NULL AS one_sided
  FROM (SELECT batch_id, sensor, metric_name, a.metric_value AS original_value, b.metric_value AS new_value,
               abs(b.metric_value - a.metric_value) AS abs_diff,
               CASE WHEN a.metric_value <> 0 THEN abs(b.metric_value - a.metric_value) / abs(a.metric_value) * 100
                    WHEN b.metric_value = a.metric_value THEN 0.0
                    WHEN b.metric_value <> a.metric_value THEN 'inf'::DOUBLE END AS rel_diff_pct
        FROM metrics_a a FULL OUTER JOIN metrics_b b USING (batch_id, sensor, metric_name)))""",
)
REPLAY_COLUMNS = (
    "batch_id, sensor, metric_name, " + _r("original_value", "new_value", "abs_diff", "rel_diff_pct")
    + ", within_tolerance, one_sided"
)
ORACLES["replay_diff"] = _with(*REPLAY) + f"SELECT {REPLAY_COLUMNS} FROM compared WHERE one_sided OR abs_diff > 0"
ORACLES["replay_first20"] = _with(*REPLAY) + f"""
SELECT {REPLAY_COLUMNS} FROM (
  SELECT * FROM compared WHERE one_sided OR abs_diff > 0 ORDER BY batch_id, sensor, metric_name LIMIT 20)"""
ORACLES["replay_verdict"] = _with(*REPLAY) + """
SELECT batch_id, count(*) AS total_metrics_compared,
       count(*) FILTER (one_sided OR abs_diff > 0) AS metrics_with_diff,
       count(*) FILTER ((one_sided OR abs_diff > 0) AND NOT within_tolerance) AS metrics_out_of_tolerance,
       bool_and(NOT (one_sided OR abs_diff > 0) OR within_tolerance) AS acceptable
FROM compared GROUP BY 1"""
ORACLES["even_sample"] = _with(SCATTERED) + """
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, row_number) - 1 AS idx,
         count(*) OVER (PARTITION BY batch_id) AS n FROM readings),
wanted AS (
  SELECT DISTINCT batch_id, (i * (n - 1)) // greatest(least(10, n) - 1, 1) AS idx
  FROM (SELECT batch_id, n, unnest(range(0, least(10, n))) AS i FROM (SELECT DISTINCT batch_id, n FROM placed)))
SELECT p.batch_id, p.idx, row_number, ts, sensor, value FROM placed p JOIN wanted w ON p.batch_id = w.batch_id AND p.idx = w.idx"""
ORACLES["even_sample_sliced"] = ORACLES["even_sample"]
ORACLES["manifest_summary"] = _with(RUNS, RUN_METRICS, RUN_ANOMALIES, RUN_ERRORS) + """
SELECT r.run_id, batch_id, run_number, config_version, coalesce(m.n, 0) AS total_metrics,
       coalesce(a.n, 0) AS total_anomalies, coalesce(e.n, 0) AS total_errors
FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM run_metrics GROUP BY 1) m ON m.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_anomalies GROUP BY 1) a ON a.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_errors GROUP BY 1) e ON e.run_id = r.run_id"""

ORACLES["snapshot_manifest"] = _with(RUNS, RUN_METRICS, RUN_ANOMALIES, RUN_ERRORS, BATCHES) + """
SELECT r.run_id, batch_name, run_number,
       sha256('{"anomaly_detection": {"zscore_threshold": ' || CAST(c_nationkey % 3 + 1 AS VARCHAR) ||
              '}, "cleaning": {"remove_duplicates": true}, "metrics": {"compute_mean": true}, ' ||
              '"missing_values": {"strategy": "fill"}, "version": ' || CAST(b.config_version AS VARCHAR) || '}') AS config_sha256,
       coalesce(m.n, 0) AS total_metrics, coalesce(a.n, 0) AS total_anomalies, coalesce(e.n, 0) AS total_errors,
       coalesce(a.kinds, '') AS anomaly_type_counts, coalesce(e.kinds, '') AS error_type_counts
FROM runs r JOIN batches b ON b.batch_id = r.batch_id JOIN customer ON c_custkey = r.batch_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM run_metrics GROUP BY 1) m ON m.run_id = r.run_id
LEFT JOIN (SELECT run_id, CAST(sum(k) AS BIGINT) AS n, string_agg(anomaly_type || '=' || CAST(k AS VARCHAR), ',' ORDER BY anomaly_type) AS kinds
           FROM (SELECT run_id, anomaly_type, count(*) AS k FROM run_anomalies GROUP BY 1, 2) GROUP BY 1) a ON a.run_id = r.run_id
LEFT JOIN (SELECT run_id, CAST(sum(k) AS BIGINT) AS n, string_agg(error_type || '=' || CAST(k AS VARCHAR), ',' ORDER BY error_type) AS kinds
           FROM (SELECT run_id, error_type, count(*) AS k FROM run_errors GROUP BY 1, 2) GROUP BY 1) e ON e.run_id = r.run_id"""
ORACLES["snapshot_package"] = _with(RUNS, RUN_METRICS, RUN_ANOMALIES, RUN_ERRORS, BATCHES) + """
SELECT 'manifest' AS part, count(*) AS n, CAST((SELECT count(*) FROM run_metrics WHERE run_id IN (SELECT run_id FROM runs)) AS DOUBLE) AS total FROM runs
UNION ALL SELECT 'config', count(*), CAST(sum(length(config_json)) AS DOUBLE) FROM runs JOIN batches USING (batch_id)
UNION ALL SELECT 'source_summary', count(DISTINCT batch_id), CAST(sum(rows_processed) AS DOUBLE) FROM runs
UNION ALL SELECT 'dependencies', 1, 0
UNION ALL SELECT 'metrics', count(*), round(sum(metric_value), 3) FROM run_metrics WHERE run_id IN (SELECT run_id FROM runs)
UNION ALL SELECT 'anomalies', count(*), round(sum(value), 3) FROM run_anomalies WHERE run_id IN (SELECT run_id FROM runs)
UNION ALL SELECT 'errors', count(*), CAST(sum(row_number) AS DOUBLE) FROM run_errors WHERE run_id IN (SELECT run_id FROM runs)"""
ORACLES["baseline_package"] = _with(RUNS, RUN_METRICS, BATCHES) + """
, held AS (SELECT c_custkey AS id FROM customer),
checks AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders WHERE o_custkey IN (SELECT id FROM held))
SELECT 'baseline_summary' AS part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, (SELECT count(*) FROM checks) AS total FROM held
UNION ALL SELECT 'config', count(*), CAST(sum(id) AS BIGINT), NULL FROM held
UNION ALL SELECT 'metric_thresholds', count(*), CAST(sum(run_id % 100) AS BIGINT), NULL FROM run_metrics WHERE run_id % 100 IN (SELECT id FROM held)
UNION ALL SELECT 'source_summary', count(DISTINCT batch_id), (SELECT CAST(sum(id) AS BIGINT) FROM held WHERE id IN (SELECT batch_id FROM runs)),
                 CAST(sum(rows_processed) AS BIGINT) FROM runs WHERE batch_id IN (SELECT id FROM held)
UNION ALL SELECT 'check_history', count(*), CAST(sum(id) AS BIGINT), NULL FROM checks"""
BASELINE_IMPORT = """existing AS (SELECT c_custkey AS id, 'base_' || CAST(c_custkey * 5 AS VARCHAR) AS name FROM customer),
incoming AS (SELECT batch_id AS seq, 'base_' || CAST(batch_id AS VARCHAR) AS name, config_json FROM batches),
clashing AS (SELECT i.*, e.id AS target FROM incoming i LEFT JOIN existing e USING (name)),
checks AS (
  SELECT o_custkey AS seq, arg_max(CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warn' ELSE 'block' END, o_orderkey) AS last_check_status
  FROM orders GROUP BY 1)"""
ORACLES["baseline_import_rename"] = _with(BATCHES, BASELINE_IMPORT, RUN_METRICS) + """
, counts AS (SELECT run_id % 100 AS seq, count(*) AS n FROM run_metrics GROUP BY 1)
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY seq) AS baseline_id,
       name || CASE WHEN target IS NULL THEN '' ELSE '_imported' END AS name, CAST(NULL AS BIGINT) AS source_batch_id, config_json, last_check_status,
       name AS original_name, seq AS original_id, '/packages/base' AS imported_from, coalesce(n, 0) AS thresholds
FROM clashing LEFT JOIN checks USING (seq) LEFT JOIN counts USING (seq)"""
ORACLES["baseline_import_audit"] = _with(BATCHES, BASELINE_IMPORT) + """
, stored AS (SELECT seq, (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY seq) AS new_id FROM clashing WHERE target IS NULL)
SELECT 'baseline_import' AS action, seq AS original_id, new_id AS baseline_id, name AS original_name, CASE WHEN target IS NULL THEN name END AS final_name,
       CASE WHEN target IS NOT NULL THEN 'reject' END AS conflict_action, CASE WHEN target IS NULL THEN 'success' ELSE 'blocked' END AS result,
       CASE WHEN target IS NOT NULL THEN 'name_exists' END AS error_message, '/packages/base' AS imported_from
FROM clashing LEFT JOIN stored USING (seq)"""
ORACLES["snapshot_import"] = _with(RUNS, RUN_METRICS, BATCHES) + """
, named AS (SELECT run_id, run_number, batch_name || ' #' || CAST(run_number AS VARCHAR) AS name FROM runs JOIN batches USING (batch_id)),
stored AS (
  SELECT run_id AS original_id, name, (SELECT max(run_id) FROM named WHERE run_number = 1) + row_number() OVER (ORDER BY run_id) AS run_id
  FROM named WHERE run_number > 1),
held AS (SELECT run_id AS original_id, count(*) AS metrics, round(sum(metric_value), 6) AS total FROM run_metrics GROUP BY 1)
SELECT run_id, name, name AS original_name, original_id, metrics, total FROM stored LEFT JOIN held USING (original_id)"""
ORACLES["run_records"] = _with(CSV_FIELDS) + """
SELECT p.batch_id, 'success' AS run_status, rows_processed, coalesce(n, 0) AS rows_errors
FROM (SELECT batch_id, count(DISTINCT ts) AS rows_processed FROM cells GROUP BY 1) p
LEFT JOIN (SELECT batch_id, count(*) AS n FROM errors GROUP BY 1) e ON p.batch_id = e.batch_id"""

# --- exports ------------------------------------------------------------------------

DESCRIBED = "l.batch_id, batch_name, l.run_id, run_number, l.config_version"
OF_RUN = "JOIN latest l ON l.run_id = x.run_id JOIN batches b ON b.batch_id = l.batch_id"
ORACLES["export_metrics"] = _with(RUNS, RUN_METRICS, BATCHES) + f"""
SELECT {DESCRIBED}, sensor, metric_name AS metric, round(metric_value, 6) AS value FROM run_metrics x {OF_RUN}"""
ORACLES["export_errors"] = _with(RUNS, RUN_ERRORS, BATCHES) + f"""
SELECT {DESCRIBED}, row_number, error_type, error_detail, raw_data FROM run_errors x {OF_RUN}"""
ORACLES["export_anomalies"] = _with(RUNS, RUN_ANOMALIES, BATCHES) + f"""
SELECT {DESCRIBED}, sensor, row_number, "timestamp", value, anomaly_type FROM run_anomalies x {OF_RUN}"""

EVENTS_LOG = """ticket_log AS (
  SELECT c_custkey AS ticket_id, CAST(-1 AS BIGINT) AS seq, 'create' AS action,
         CASE WHEN c_nationkey % 2 = 0 THEN 'desk' END AS payload,
         CAST(NULL AS VARCHAR) AS closer, CAST(NULL AS VARCHAR) AS created_at FROM customer
  UNION ALL
  SELECT o_custkey, o_orderkey,
         CASE o_orderkey % 4 WHEN 0 THEN 'assign' WHEN 1 THEN 'resolve' WHEN 2 THEN 'reopen' ELSE 'comment' END,
         CASE WHEN o_orderkey % 4 = 0 THEN 'user' || CAST(o_orderkey % 10 AS VARCHAR)
              ELSE 'note ' || CAST(o_orderkey AS VARCHAR) END,
         CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 'closer' || CAST(o_orderkey % 10 AS VARCHAR) END,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY seq) AS nth FROM ticket_log),
folded AS (
  SELECT ticket_id, nth, seq, action, true AS ok, CASE WHEN payload IS NULL THEN 'open' ELSE 'assigned' END AS status,
         payload AS assignee, CAST(NULL AS VARCHAR) AS resolution FROM numbered WHERE nth = 1
  UNION ALL
  SELECT n.ticket_id, n.nth, n.seq, n.action,
         CASE WHEN n.action IN ('assign', 'resolve') THEN f.status IN ('open', 'assigned', 'reopened')
              WHEN n.action = 'reopen' THEN f.status = 'resolved' ELSE true END,
         CASE WHEN n.action = 'assign' AND f.status <> 'resolved' THEN 'assigned'
              WHEN n.action = 'resolve' AND f.status <> 'resolved' THEN 'resolved'
              WHEN n.action = 'reopen' AND f.status = 'resolved' THEN 'reopened' ELSE f.status END,
         CASE WHEN n.action = 'assign' AND f.status <> 'resolved' THEN n.payload
              WHEN n.action = 'resolve' AND f.status <> 'resolved' THEN coalesce(n.closer, f.assignee) ELSE f.assignee END,
         CASE WHEN n.action = 'resolve' AND f.status <> 'resolved' THEN n.payload ELSE f.resolution END
  FROM folded f JOIN numbered n ON n.ticket_id = f.ticket_id AND n.nth = f.nth + 1)"""
ORACLES["ticket_state"] = _with(EVENTS_LOG) + """
SELECT ticket_id, arg_max(status, nth) AS status,
       max(CASE WHEN nth = last_nth THEN assignee END) AS assignee,
       max(CASE WHEN nth = last_nth THEN resolution END) AS resolution,
       count(*) FILTER (ok) AS accepted_events, count(*) FILTER (NOT ok) AS rejected_events
FROM (SELECT *, max(nth) OVER (PARTITION BY ticket_id) AS last_nth FROM folded) GROUP BY 1"""
ORACLES["ticket_state_sliced"] = ORACLES["ticket_state"]
ORACLES["ticket_illegal"] = _with(EVENTS_LOG) + """
SELECT ticket_id, seq, action, CASE WHEN action = 'reopen' THEN 'not_resolved' ELSE 'already_resolved' END AS reason
FROM folded WHERE NOT ok"""
ORACLES["ticket_export_docs"] = _with(EVENTS_LOG) + """
, notes AS (
  SELECT *, (row_number() OVER (PARTITION BY ticket_id ORDER BY seq) - 1) // 1000 AS part
  FROM ticket_log WHERE action <> 'create')
SELECT c_custkey AS ticket_id, c_name AS title,
       CASE c_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' ELSE 'resolved' END AS status,
       CASE WHEN c_nationkey % 4 = 0 THEN c_custkey - 1 ELSE c_custkey END AS original_ticket_id,
       coalesce(part, 0) AS part, 1000 * coalesce(part, 0) AS notes_before,
       coalesce(string_agg(action || '|' || payload || '|' || created_at, ';' ORDER BY seq), '') AS timeline
FROM customer LEFT JOIN notes ON ticket_id = c_custkey GROUP BY ALL"""
ORACLES["ticket_file_timelines"] = _with(EVENTS_LOG) + """
, told AS (
  SELECT ticket_id, count(*) AS notes, count(*) - 1 AS last, arg_max(payload, seq) AS last_note, arg_min(action, seq) AS first_type
  FROM ticket_log WHERE action <> 'create' GROUP BY 1)
SELECT c_name AS title, CASE c_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' ELSE 'resolved' END AS status,
       CASE WHEN c_nationkey % 5 <> 4 THEN c_nationkey END AS source_batch_id, CASE WHEN c_nationkey % 7 <> 6 THEN c_custkey % 11 END AS source_run_id,
       c_mktsegment AS assignee, CASE WHEN c_nationkey % 4 = 0 THEN c_custkey - 1 ELSE c_custkey END AS original_ticket_id,
       notes, last, last_note, first_type
FROM customer LEFT JOIN told ON ticket_id = c_custkey"""
ORACLES["first_errors"] = _with(RUN_ERRORS) + """
SELECT run_id, count(*) AS errors, CAST(sum(row_number) AS BIGINT) AS rows
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY row_number) AS nth FROM run_errors) WHERE nth <= 2 GROUP BY 1"""
ORACLES["run_numbers_appended"] = _with(RUNS) + """
, odd AS (SELECT batch_id, count(*) AS n FROM runs WHERE run_id % 2 = 1 GROUP BY 1)
SELECT run_id, batch_id, coalesce(n, 0) + row_number() OVER (PARTITION BY batch_id ORDER BY run_id) AS run_number
FROM runs LEFT JOIN odd USING (batch_id) WHERE run_id % 2 = 0"""
ORACLES["sensors_with_anomalies"] = _with(*COUNTED) + "SELECT DISTINCT sensor FROM counts"
ORACLES["ticket_conflicts"] = _with("""
incoming AS (
  SELECT o_orderkey AS seq, 'Customer#' || lpad(CAST(o_orderkey * 2 AS VARCHAR), 9, '0') AS title,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 30 END AS b,
         CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 THEN o_orderkey % 13 END AS r FROM orders),
held AS (
  SELECT c_custkey AS id, c_name AS title, CASE WHEN c_nationkey % 5 <> 4 THEN c_nationkey END AS b,
         CASE WHEN c_nationkey % 7 <> 6 THEN c_custkey % 11 END AS r FROM customer),
sources AS (SELECT DISTINCT b, r FROM incoming),
hits AS (
  SELECT s.b, s.r, max(h.id) AS id FROM sources s JOIN held h
  ON (s.b IS NULL OR h.b = s.b) AND (s.r IS NULL OR h.r = s.r) AND (s.b IS NOT NULL OR s.r IS NOT NULL) GROUP BY 1, 2)""") + """
SELECT seq, i.title, CASE WHEN t.id IS NOT NULL THEN 'title_exists' WHEN h.id IS NOT NULL THEN 'source_exists' END AS conflict_type,
       coalesce(t.id, h.id) AS existing_id
FROM incoming i LEFT JOIN held t ON t.title = i.title
LEFT JOIN hits h ON h.b IS NOT DISTINCT FROM i.b AND h.r IS NOT DISTINCT FROM i.r"""

# --- configurations -----------------------------------------------------------------

SCHEMES = """schemes AS (
  SELECT s_suppkey AS scheme_id, s_name AS name, s_nationkey AS n, 1 + s_suppkey % 5 AS version,
         CASE s_nationkey % 4 WHEN 0 THEN '2.0' WHEN 1 THEN '1.1' WHEN 2 THEN '1.0' END AS scheme_version,
         s_nationkey % 5 = 0 AS partial,
         CASE WHEN s_nationkey % 2 = 1 THEN s_suppkey - 1 END AS source_scheme_id,
         CASE WHEN s_nationkey % 6 = 0 THEN s_suppkey // 2 END AS original_id
  FROM supplier)"""


def _config(version: str, threshold: str) -> str:
    return (
        f"""'{{"version": ' || CAST({version} AS VARCHAR) || ', "cleaning": {{"remove_duplicates": true}}, """
        f""""missing_values": {{"strategy": "fill"}}, "metrics": {{"compute_mean": true}}, """
        f""""anomaly_detection": {{"zscore_threshold": ' || CAST({threshold} AS VARCHAR) || '}}}}'"""
    )


HISTORY = f"""history AS (
  SELECT o_orderkey AS id, o_custkey AS batch_id, o_orderkey % 25 AS scheme_id,
         'scheme_' || CAST(o_orderkey % 25 AS VARCHAR) AS scheme_name,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS source_scheme_id, o_orderkey % 9 + 1 AS config_version,
         o_orderkey % 4 + 1 AS threshold, {_config("o_orderkey % 9 + 1", "o_orderkey % 4 + 1")} AS config_json,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'rollback' ELSE 'apply' END AS action,
         CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey - 1 END AS rolled_back_from_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth
  FROM orders)"""
ORACLES["scheme_files"] = _with(SCHEMES) + f"""
SELECT name, scheme_version, CASE WHEN partial THEN '{{"version": ' || CAST(version AS VARCHAR) || ', "cleaning": {{}}}}'
       ELSE {_config("version", "n % 3 + 1")} END AS config, source_scheme_id, coalesce(original_id, scheme_id) AS original_id FROM schemes"""
ORACLES["eligible_batches"] = "SELECT c_custkey AS batch_id, c_name AS batch_name FROM customer WHERE c_nationkey % 5 <> 0"
ORACLES["config_missing_fields"] = _with(SCHEMES) + (
    "SELECT scheme_id, 'missing_values,anomaly_detection,metrics' AS missing FROM schemes WHERE partial"
)
ORACLES["version_compat"] = _with(SCHEMES) + (
    "SELECT scheme_id, scheme_version, coalesce(scheme_version LIKE '1.%', false) AS compatible FROM schemes"
)
ORACLES["config_diff"] = _with(HISTORY) + """
, both_sides AS (
  SELECT id, config_version AS v0, 1 + c_custkey % 4 AS v1, threshold AS t0, c_nationkey % 3 + 1 AS t1
  FROM history JOIN customer ON c_custkey = batch_id)
SELECT id, 'version' AS path, 'modified' AS change, CAST(v0 AS VARCHAR) AS old_value, CAST(v1 AS VARCHAR) AS new_value
FROM both_sides WHERE v0 <> v1
UNION ALL
SELECT id, 'anomaly_detection.zscore_threshold', 'modified', CAST(t0 AS VARCHAR), CAST(t1 AS VARCHAR)
FROM both_sides WHERE t0 <> t1"""
ORACLES["config_diff_shapes"] = """
WITH d AS (
  SELECT o_orderkey AS id, o_orderkey % 5 AS shape, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS a, CAST(o_orderkey % 4 AS VARCHAR) AS c
  FROM orders)
SELECT id, 'version' AS path, 'modified' AS change, a AS old_value, c AS new_value FROM d WHERE shape = 0 AND a <> c
UNION ALL SELECT id, 'note', 'modified', '{' || a || '} "x"', '{' || c || '} "x"' FROM d WHERE shape = 0 AND a <> c
UNION ALL SELECT id, 'l1.l2.l3.l4.l5', 'modified', a, c FROM d WHERE shape = 1 AND a <> c
UNION ALL SELECT id, 'cleaning.remove', 'added', NULL, c FROM d WHERE shape = 2
UNION ALL SELECT id, 'x', 'added', NULL, c FROM d WHERE shape = 3
UNION ALL SELECT id, 'x', 'modified', a, a FROM d WHERE shape = 4"""
ORACLES["scheme_lineage"] = _with(SCHEMES) + """
SELECT a.scheme_id, a.name, a.source_scheme_id, s.name AS source_scheme_name,
       coalesce(a.original_id, a.scheme_id) AS root_id, c.id AS newest_copy_id, n.name AS newest_copy_name
FROM schemes a LEFT JOIN schemes s ON s.scheme_id = a.source_scheme_id
LEFT JOIN (SELECT original_id, max(scheme_id) AS id FROM schemes WHERE original_id IS NOT NULL GROUP BY 1) c
  ON c.original_id = a.scheme_id
LEFT JOIN schemes n ON n.scheme_id = c.id"""
REQUESTS = """requests AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN -o_custkey - 1 ELSE o_custkey END AS batch_id,
         o_orderkey % 120 AS scheme_id,
         CASE WHEN o_orderstatus = 'O' THEN 'Supplier#' || lpad(CAST(o_orderkey % 200 AS VARCHAR), 9, '0') END AS new_name,
         CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 150 END AS source_scheme_id
  FROM orders),
checked AS (
  SELECT q.request_id, q.batch_id, q.scheme_id, q.new_name, q.source_scheme_id, s.name AS scheme_name, z.name AS source_scheme_name,
         c.c_custkey IS NULL AS no_batch, s.scheme_id IS NULL AS no_scheme, c.c_nationkey % 5 = 0 AS locked,
         x.name IS NOT NULL AS clash, q.source_scheme_id IS NOT NULL AND z.name IS NULL AS no_source,
         s.scheme_id IS NOT NULL AND coalesce(s.scheme_version NOT LIKE '1.%', true) AS other_version, s.partial,
         1 + c.c_custkey % 4 AS current_version, c.c_nationkey AS batch_nation,
         CASE WHEN c.c_custkey IS NOT NULL THEN s.version + 1 END AS new_version,
         s.scheme_version, s.source_scheme_id AS own_source, s.n, s.version
  FROM requests q LEFT JOIN customer c ON c.c_custkey = q.batch_id
  LEFT JOIN schemes s ON s.scheme_id = q.scheme_id
  LEFT JOIN schemes x ON x.name = q.new_name
  LEFT JOIN schemes z ON z.scheme_id = q.source_scheme_id),
decided AS (
  SELECT *, NOT (no_batch OR no_scheme OR coalesce(locked, false) OR clash OR no_source OR coalesce(partial, false)) AS can_proceed
  FROM checked)"""
ORACLES["apply_precheck"] = _with(SCHEMES, REQUESTS) + """
SELECT request_id, batch_id, scheme_id, scheme_name, source_scheme_name,
       concat_ws(',', CASE WHEN no_batch THEN 'batch_not_found' END, CASE WHEN no_scheme THEN 'scheme_not_found' END,
                 CASE WHEN locked THEN 'batch_locked' END, CASE WHEN clash THEN 'name_conflict' END,
                 CASE WHEN no_source THEN 'source_missing' END, CASE WHEN other_version THEN 'version_mismatch' END,
                 CASE WHEN partial THEN 'config_incomplete' END) AS risks,
       can_proceed, current_version, new_version FROM decided"""
ORACLES["apply_schemes"] = _with(SCHEMES, REQUESTS, BATCHES, HISTORY) + f"""
SELECT request_id, batch_id, scheme_id, scheme_name, own_source AS source_scheme_id, new_version AS config_version,
       {_config("new_version", "n % 3 + 1")} AS config_json, 'apply' AS action FROM decided WHERE can_proceed
UNION ALL
SELECT NULL, batch_id, NULL, NULL, NULL, config_version, config_json, 'baseline' FROM batches
WHERE batch_id IN (SELECT batch_id FROM decided WHERE can_proceed) AND batch_id NOT IN (SELECT batch_id FROM history)"""
ORACLES["apply_schemes_audit"] = _with(SCHEMES, REQUESTS) + f"""
, chained AS (
  SELECT request_id, coalesce(lag(new_version) OVER w, current_version) AS v0,
         coalesce(lag(n % 3 + 1) OVER w, batch_nation % 3 + 1) AS t0, new_version AS v1, n % 3 + 1 AS t1
  FROM decided WHERE can_proceed WINDOW w AS (PARTITION BY batch_id ORDER BY request_id))
SELECT d.request_id, batch_id, scheme_id, CASE WHEN can_proceed THEN 'success' ELSE 'blocked' END AS result,
       CASE WHEN can_proceed THEN {_config("v0", "t0")}
            WHEN NOT no_batch AND NOT no_scheme THEN {_config("current_version", "batch_nation % 3 + 1")} END AS previous_config_json,
       CASE WHEN can_proceed THEN {_config("v1", "t1")} END AS new_config_json,
       coalesce(CAST(v0 <> v1 AS INTEGER) + CAST(t0 <> t1 AS INTEGER), 0) AS changes, v1 < v0 AS version_regressed
FROM decided d LEFT JOIN chained c ON c.request_id = d.request_id"""
ORACLES["derive_apply_schemes"] = _with(SCHEMES, REQUESTS) + f"""
, winners AS (
  SELECT * FROM decided WHERE request_id IN (
    SELECT min(request_id) FROM decided WHERE can_proceed AND new_name IS NOT NULL GROUP BY new_name))
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY request_id) AS scheme_id, new_name AS name,
       scheme_version, {_config("version", "n % 3 + 1")} AS config_json, scheme_id AS source_scheme_id FROM winners"""
ORACLES["rollback_targets"] = _with(HISTORY) + """
SELECT a.batch_id, a.id AS latest_id, a.config_version AS latest_config_version, p.id AS target_id,
       p.scheme_name AS target_scheme_name, p.config_version AS target_config_version
FROM history a LEFT JOIN history p ON p.batch_id = a.batch_id AND p.nth = 2 WHERE a.nth = 1"""
ORACLES["rollback_precheck"] = _with(SCHEMES, REQUESTS, HISTORY) + """
SELECT q.batch_id, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'batch_not_found' END,
         CASE WHEN c_nationkey % 5 = 0 THEN 'batch_locked' END,
         CASE WHEN c_custkey IS NOT NULL AND a.id IS NULL THEN 'no_history' END,
         CASE WHEN c_custkey IS NOT NULL AND a.id IS NOT NULL AND p.id IS NULL THEN 'already_first' END) AS risks,
       c_custkey IS NOT NULL AND c_nationkey % 5 <> 0 AND p.id IS NOT NULL AS can_proceed,
       CASE WHEN c_custkey IS NOT NULL AND p.id IS NOT NULL THEN a.config_version + 1 END AS new_version
FROM (SELECT DISTINCT batch_id FROM requests) q LEFT JOIN customer ON c_custkey = q.batch_id
LEFT JOIN history a ON a.batch_id = q.batch_id AND a.nth = 1
LEFT JOIN history p ON p.batch_id = q.batch_id AND p.nth = 2"""
ORACLES["apply_rollback"] = _with(HISTORY) + f"""
SELECT a.batch_id, p.scheme_id, p.scheme_name, p.source_scheme_id, a.config_version + 1 AS config_version,
       {_config("a.config_version + 1", "p.threshold")} AS config_json, 'rollback' AS action, a.id AS rolled_back_from_id
FROM history a JOIN history p ON p.batch_id = a.batch_id AND p.nth = 2 JOIN customer ON c_custkey = a.batch_id
WHERE a.nth = 1 AND c_nationkey % 5 <> 0"""
ORACLES["rollback_batches"] = _with(HISTORY) + f"""
SELECT a.batch_id, p.scheme_id AS current_scheme_id, p.scheme_name AS current_scheme_name,
       a.config_version + 1 AS config_version, {_config("a.config_version + 1", "p.threshold")} AS config_json
FROM history a JOIN history p ON p.batch_id = a.batch_id AND p.nth = 2 JOIN customer ON c_custkey = a.batch_id
WHERE a.nth = 1 AND c_nationkey % 5 <> 0"""
ORACLES["rollback_audit"] = _with(BATCHES, HISTORY) + f"""
, judged AS (
  SELECT b.batch_id, b.config_json, b.config_version AS v0, c_nationkey % 3 + 1 AS t0, a.config_version + 1 AS v1, p.threshold AS t1,
         p.scheme_id, p.scheme_name, p.source_scheme_id, NOT locked AND p.id IS NOT NULL AS done,
         CASE WHEN locked THEN 'batch_locked' WHEN a.id IS NULL THEN 'no_history' WHEN p.id IS NULL THEN 'already_first' END AS reason
  FROM batches b JOIN customer ON c_custkey = b.batch_id
  LEFT JOIN history a ON a.batch_id = b.batch_id AND a.nth = 1
  LEFT JOIN history p ON p.batch_id = b.batch_id AND p.nth = 2)
SELECT batch_id, CASE WHEN done THEN scheme_id END AS scheme_id, CASE WHEN done THEN scheme_name END AS scheme_name,
       CASE WHEN done THEN source_scheme_id END AS source_scheme_id, 'rollback' AS action,
       CASE WHEN done THEN 'success' WHEN reason = 'batch_locked' THEN 'blocked' ELSE 'failed' END AS result,
       config_json AS previous_config_json, CASE WHEN done THEN {_config("v1", "t1")} END AS new_config_json,
       CASE WHEN done THEN CAST(v0 <> v1 AS INTEGER) + CAST(t0 <> t1 AS INTEGER) ELSE 0 END AS changes, reason AS error_message
FROM judged"""
ORACLES["apply_dry_run"] = _with(SCHEMES, REQUESTS) + f"""
SELECT request_id, batch_id, scheme_id, scheme_name, source_scheme_id, 'dry_run' AS action,
       CASE WHEN can_proceed THEN 'success' ELSE 'blocked' END AS result,
       CASE WHEN NOT no_batch AND NOT no_scheme THEN {_config("current_version", "batch_nation % 3 + 1")} END AS previous_config_json,
       CASE WHEN no_batch OR no_scheme THEN NULL
            WHEN partial THEN '{{"version": ' || CAST(new_version AS VARCHAR) || ', "cleaning": {{}}}}'
            ELSE {_config("new_version", "n % 3 + 1")} END AS new_config_json,
       CASE WHEN no_batch OR no_scheme THEN 0 ELSE CAST(current_version <> new_version AS INTEGER)
            + CASE WHEN partial THEN 4 ELSE CAST(batch_nation % 3 <> n % 3 AS INTEGER) END END AS changes
FROM decided"""
AUDIT = """audit AS (
  SELECT o_orderkey AS id, o_custkey AS batch_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'apply' WHEN '2-HIGH' THEN 'rollback' WHEN '3-MEDIUM' THEN 'import'
              WHEN '4-NOT SPECIFIED' THEN 'direct_modify' ELSE 'dry_run' END AS action,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'blocked' END AS result,
         o_orderkey % 25 AS scheme_id,
         CASE WHEN o_orderstatus = 'O' THEN 'error ' || CAST(o_orderkey % 4 AS VARCHAR) END AS error_message, {old} AS previous_config_json, {new} AS new_config_json
  FROM orders)""".format(old=_config("o_orderkey % 9 + 1", "1"), new=_config("o_orderkey % 9 + 2", "o_orderkey % 3 + 1"))
ORACLES["last_change"] = _with(BATCHES, AUDIT, SCHEMES, HISTORY) + """
SELECT b.batch_id, batch_name, locked, b.config_version, a.id AS audit_id, a.action, result, a.scheme_id,
       s.name AS scheme_name, s.scheme_version, error_message, a.id % 9 + 1 AS old_version, a.id % 9 + 2 AS new_version,
       CASE WHEN a.id IS NULL THEN '' WHEN a.id % 3 = 0 THEN 'version' ELSE 'version,anomaly_detection.zscore_threshold' END AS changed,
       CASE WHEN a.action = 'rollback' THEN h.rolled_back_from_id END AS rolled_back_from_id,
       CASE WHEN a.action = 'rollback' AND h.rolled_back_from_id IS NOT NULL THEN h.scheme_id END AS rolled_back_to_scheme_id,
       CASE WHEN a.action = 'rollback' AND h.rolled_back_from_id IS NOT NULL THEN h.scheme_name END AS rolled_back_to_scheme_name
FROM batches b
LEFT JOIN (SELECT * FROM audit WHERE id IN (SELECT max(id) FROM audit WHERE action <> 'dry_run' GROUP BY batch_id)) a
  ON a.batch_id = b.batch_id
LEFT JOIN schemes s ON s.scheme_id = a.scheme_id
LEFT JOIN history h ON h.batch_id = b.batch_id AND h.nth = 1"""
ORACLES["history_seed"] = _with(BATCHES, HISTORY) + """
SELECT batch_id, config_version, config_json, 'baseline' AS action FROM batches
WHERE batch_id NOT IN (SELECT batch_id FROM history)"""

# --- runs and listings --------------------------------------------------------------

RUN_COLUMNS = "run_id, batch_id, run_status, config_version, rows_processed, rows_errors"
ORACLES["latest_run"] = _with(RUNS) + f"SELECT {RUN_COLUMNS} FROM latest"
ORACLES["latest_successful_run"] = _with(RUNS) + f"""
SELECT {RUN_COLUMNS} FROM runs WHERE run_id IN (SELECT max(run_id) FROM runs WHERE run_status = 'success' GROUP BY batch_id)"""
ORACLES["run_numbers"] = _with(RUNS) + "SELECT run_id, batch_id, run_number FROM runs"
ORACLES["batch_status"] = _with(RUNS, BATCHES) + """
SELECT b.batch_id, CASE WHEN locked THEN 'locked' WHEN run_status = 'success' THEN 'processed'
                        WHEN run_status = 'failed' THEN 'failed' ELSE 'pending' END AS batch_status
FROM batches b LEFT JOIN latest l ON l.batch_id = b.batch_id"""
ORACLES["audit_query"] = _with(AUDIT) + """
SELECT * FROM audit WHERE action = 'apply' AND result = 'failed' ORDER BY id DESC LIMIT 100"""
ORACLES["ticket_list"] = """
SELECT * FROM (
  SELECT c_custkey AS ticket_id, c_name AS title,
         CASE WHEN c_nationkey % 5 <> 4 THEN CAST(c_nationkey AS BIGINT) END AS source_batch_id,
         CASE WHEN c_nationkey % 7 <> 6 THEN c_custkey % 11 END AS source_run_id,
         CASE c_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' ELSE 'resolved' END AS status,
         c_mktsegment AS assignee, CASE WHEN c_nationkey % 4 = 0 THEN c_custkey - 1 END AS original_ticket_id
  FROM customer)
WHERE status = 'open' AND assignee = 'BUILDING' ORDER BY ticket_id DESC LIMIT 100"""
ORACLES["listing_runs"] = _with(RUNS) + "SELECT run_id, batch_id, run_status FROM runs ORDER BY run_id DESC"

# --- merge --------------------------------------------------------------------------

MERGE = """existing AS (
  SELECT s_suppkey * 10 AS id, s_name AS name FROM supplier
  UNION ALL SELECT s_suppkey * 10 + 1, s_name || '_imported' FROM supplier WHERE s_nationkey % 3 = 0
  UNION ALL SELECT s_suppkey * 10 + CASE WHEN s_nationkey % 3 = 0 THEN 2 ELSE 1 END, s_name || '_imported_2'
            FROM supplier WHERE s_nationkey % 4 = 0),
incoming AS (
  SELECT o_orderkey AS seq, 'Supplier#' || lpad(CAST(o_custkey % 300 AS VARCHAR), 9, '0') AS name FROM orders),
judged AS (
  SELECT i.seq, i.name, e.id AS target_id,
         e.id IS NOT NULL OR i.seq <> min(i.seq) OVER (PARTITION BY i.name) AS conflict
  FROM incoming i LEFT JOIN existing e ON e.name = i.name)"""
for policy in ("reject", "skip"):
    ORACLES[f"merge_{policy}"] = _with(MERGE) + f"""
SELECT seq, name, CASE WHEN conflict THEN '{policy}' ELSE 'insert' END AS action,
       CASE WHEN NOT conflict THEN name END AS final_name, target_id FROM judged"""
ORACLES["merge_overwrite"] = _with(MERGE) + """
, arrived AS (SELECT name, max(seq) AS last_seq, min(seq) AS first_seq FROM incoming GROUP BY 1)
SELECT e.id, e.name, CASE WHEN a.last_seq IS NULL THEN 'old' ELSE 'new ' || CAST(a.last_seq AS VARCHAR) END AS config,
       NULL AS original_name, CAST(NULL AS BIGINT) AS original_id
FROM existing e LEFT JOIN arrived a ON a.name = e.name
UNION ALL
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY first_seq), name,
       'new ' || CAST(last_seq AS VARCHAR), name, first_seq
FROM arrived WHERE name NOT IN (SELECT name FROM existing)"""
ORACLES["merge_rename"] = _with(MERGE) + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM judged WHERE conflict),
free AS (
  SELECT name, candidate, row_number() OVER (PARTITION BY name ORDER BY k) AS r
  FROM (SELECT name, k, name || '_imported' || CASE WHEN k = 0 THEN '' ELSE '_' || CAST(k AS VARCHAR) END AS candidate
        FROM (SELECT name, unnest(range(0, count(*) + 3)) AS k FROM ranked GROUP BY name))
  WHERE candidate NOT IN (SELECT name FROM existing))
SELECT seq, name, 'insert' AS action, name AS final_name, target_id FROM judged WHERE NOT conflict
UNION ALL
SELECT r.seq, r.name, 'rename', candidate, target_id FROM ranked r JOIN free f ON f.name = r.name AND f.r = r.r"""
ORACLES["merge_rename_sliced"] = ORACLES["merge_rename"]


# --- ticket import: every round decides the first open input of every key -------------

_SOURCE = "CASE WHEN b IS NOT NULL AND r IS NOT NULL THEN 'both' WHEN b IS NOT NULL THEN 'batch' WHEN r IS NOT NULL THEN 'run' END"
_HELD = """SELECT {0}, 'title' AS kind, title AS k1, NULL AS k2 FROM {1}
  UNION ALL SELECT {0}, 'both', CAST(b AS VARCHAR), r FROM {1} WHERE b IS NOT NULL AND r IS NOT NULL
  UNION ALL SELECT {0}, 'batch', CAST(b AS VARCHAR), NULL FROM {1} WHERE b IS NOT NULL
  UNION ALL SELECT {0}, 'run', CAST(r AS VARCHAR), NULL FROM {1} WHERE r IS NOT NULL"""
TICKET_FILES = f"""tickets AS (
  SELECT c_custkey AS id, c_name AS title, CASE WHEN c_nationkey % 5 <> 4 THEN c_nationkey END AS b,
         CASE WHEN c_nationkey % 7 <> 6 THEN c_custkey % 11 END AS r FROM customer),
files AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 31 <> 0 THEN 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') END AS title,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderkey // 3 END AS b,
         CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 5 <> 0) OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0) THEN o_custkey END AS r,
         CASE WHEN o_orderkey % 4 = 0 THEN 'drift' END AS trigger_rule,
         CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'reopened' END END AS status,
         CASE WHEN o_orderkey % 5 < 3 THEN 'clerk ' || CAST(o_orderkey % 9 AS VARCHAR) END AS assignee,
         CASE WHEN o_orderkey % 6 = 0 THEN 'done' END AS resolution,
         CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 100 END AS original_ticket_id,
         '/files/' || CAST(o_orderkey AS VARCHAR) || '.json' AS imported_from
  FROM orders),
named AS (SELECT * FROM files WHERE title IS NOT NULL),
held AS MATERIALIZED (SELECT kind || ':' || k1 || coalesce(':' || CAST(k2 AS VARCHAR), '') AS key, seq FROM ({_HELD.format("seq", "named")})),
asked AS MATERIALIZED (
  SELECT seq, 'title:' || title AS key FROM named
  UNION ALL
  SELECT seq, {_SOURCE} || ':' || CAST(coalesce(b, r) AS VARCHAR)
         || CASE WHEN b IS NOT NULL AND r IS NOT NULL THEN ':' || CAST(r AS VARCHAR) ELSE '' END
  FROM named WHERE b IS NOT NULL OR r IS NOT NULL),
stored AS MATERIALIZED (
  SELECT kind || ':' || k1 || coalesce(':' || CAST(k2 AS VARCHAR), '') AS key, max(id) AS id
  FROM ({_HELD.format("id", "tickets")}) GROUP BY 1)"""
REJECTING = """rounds AS (
  SELECT 0 AS n, seq, CASE WHEN seq IN (SELECT seq FROM asked JOIN stored USING (key)) THEN 2 ELSE 0 END AS state FROM named
  UNION ALL
  SELECT n + 1, o.seq, CASE WHEN state <> 0 THEN state WHEN coalesce(held < o.seq, false) THEN 2 WHEN next THEN 1 ELSE 0 END
  FROM rounds o LEFT JOIN (
    SELECT a.seq, min(taken) AS held, bool_and(open = a.seq) AS next
    FROM asked a JOIN (
      SELECT key, min(seq) FILTER (state = 1) AS taken, min(seq) FILTER (state = 0) AS open
      FROM rounds JOIN held USING (seq) GROUP BY key) k USING (key)
    GROUP BY a.seq) j ON j.seq = o.seq
  WHERE EXISTS (SELECT 1 FROM rounds WHERE state = 0)),
stored_inputs AS (SELECT seq FROM rounds WHERE n = (SELECT max(n) FROM rounds) AND state = 1),
decided AS MATERIALIZED (
  SELECT f.*, CASE WHEN s.seq IS NOT NULL THEN 'insert' ELSE 'reject' END AS action,
         CASE WHEN s.seq IS NOT NULL THEN title END AS final_title FROM named f LEFT JOIN stored_inputs s USING (seq))"""
RENAMING = """clear AS (
  SELECT f.seq, f.title, bool_and(coalesce(k.first, f.seq) = f.seq AND s.id IS NULL) AS ok FROM named f
  LEFT JOIN asked a ON a.seq = f.seq AND a.key NOT LIKE 'title:%'
  LEFT JOIN (SELECT key, min(seq) AS first FROM held GROUP BY key) k ON k.key = a.key
  LEFT JOIN stored s ON s.key = a.key GROUP BY 1, 2),
owners AS (
  SELECT title, min(seq) AS seq FROM clear WHERE ok AND title NOT IN (SELECT title FROM tickets) GROUP BY 1),
numbered AS (
  SELECT seq, title, row_number() OVER (PARTITION BY title ORDER BY seq) - 1 AS nth FROM named
  WHERE seq NOT IN (SELECT seq FROM owners)),
decided AS MATERIALIZED (
  SELECT f.*, CASE WHEN nth IS NULL THEN 'insert' ELSE 'rename' END AS action,
         f.title || CASE WHEN nth IS NULL THEN '' WHEN nth = 0 THEN '_imported' ELSE '_imported_' || CAST(nth AS VARCHAR) END AS final_title
  FROM named f LEFT JOIN numbered USING (seq))"""
IN_THE_WAY = f"""numbered_ids AS (
  SELECT seq, (SELECT max(id) FROM tickets) + row_number() OVER (ORDER BY seq) AS ticket_id FROM decided WHERE final_title IS NOT NULL),
placed AS MATERIALIZED (SELECT * FROM decided LEFT JOIN numbered_ids USING (seq)),
entered AS MATERIALIZED (
  SELECT kind || ':' || k1 || coalesce(':' || CAST(k2 AS VARCHAR), '') AS key, seq, ticket_id
  FROM ({_HELD.format("seq, ticket_id", "(SELECT * EXCLUDE (title), final_title AS title FROM placed WHERE final_title IS NOT NULL)")})),
hits AS (
  SELECT w.seq, w.key LIKE 'title:%' AS by_title, coalesce(e.ticket_id, s.id) AS hit
  FROM (SELECT a.seq, a.key, a.seq - 1 AS before FROM asked a JOIN placed p USING (seq) WHERE action <> 'insert') w
  ASOF LEFT JOIN entered e ON e.key = w.key AND e.seq <= w.before LEFT JOIN stored s ON s.key = w.key),
conflicts AS (
  SELECT seq, max(hit) FILTER (by_title) AS title_hit, max(hit) FILTER (NOT by_title) AS source_hit FROM hits GROUP BY 1),
decisions AS MATERIALIZED (
  SELECT seq, title, action, CASE WHEN title_hit IS NOT NULL THEN 'title_exists' WHEN source_hit IS NOT NULL THEN 'source_exists' END AS conflict_type,
         coalesce(title_hit, source_hit) AS existing_id, final_title, ticket_id FROM placed LEFT JOIN conflicts USING (seq)
  UNION ALL SELECT seq, NULL, 'reject', 'title_missing', NULL, NULL, NULL FROM files WHERE title IS NULL)"""
_REJECTED = f"WITH RECURSIVE {TICKET_FILES}, {REJECTING}, {IN_THE_WAY}"
ORACLES["ticket_import_reject"] = _REJECTED + " SELECT * FROM decisions"
ORACLES["ticket_import_rename"] = f"WITH {TICKET_FILES}, {RENAMING}, {IN_THE_WAY} SELECT * FROM decisions"
ORACLES["ticket_import_rows"] = _REJECTED + """, timeline AS (
  SELECT l_orderkey AS seq, count(*) AS lines, max(l_linenumber) AS last, count(*) FILTER (l_returnflag <> 'N') AS resolving
  FROM lineitem GROUP BY 1)
SELECT ticket_id, final_title AS title, b AS source_batch_id, r AS source_run_id, trigger_rule,
       coalesce(status, CASE WHEN assignee IS NOT NULL THEN 'assigned' ELSE 'open' END) AS status, assignee, resolution,
       original_ticket_id, imported_from, 1 + coalesce(lines, 0) AS notes,
       coalesce('line ' || CAST(last AS VARCHAR), 'ticket created' || coalesce(' and assigned to ' || assignee, '')) AS last_note,
       'ticket created' || coalesce(' and assigned to ' || assignee, '') AS first_note, coalesce(resolving, 0) AS resolving
FROM placed LEFT JOIN timeline USING (seq) WHERE final_title IS NOT NULL"""
ORACLES["ticket_import_audit"] = _REJECTED + """, told AS (
  SELECT d.*, f.b, f.r, f.assignee, f.original_ticket_id, f.imported_from FROM decisions d JOIN files f USING (seq))
SELECT seq, 'ticket_create' AS action, 'import' AS trigger_method, 'success' AS result, ticket_id, final_title AS ticket_title, existing_id,
       b AS source_batch_id, r AS source_run_id, assignee, original_ticket_id, imported_from, NULL AS conflict_type, NULL AS conflict_action,
       NULL AS original_title, NULL AS final_title, NULL AS error_message FROM told WHERE ticket_id IS NOT NULL
UNION ALL
SELECT seq, 'ticket_import', 'import', CASE WHEN ticket_id IS NOT NULL THEN 'success' ELSE 'blocked' END, ticket_id,
       coalesce(final_title, title), existing_id, b, r, assignee, original_ticket_id, imported_from, conflict_type,
       CASE WHEN action <> 'insert' THEN action END, title, final_title, CASE WHEN ticket_id IS NULL THEN conflict_type END FROM told"""
