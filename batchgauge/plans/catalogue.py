"""The registered queries: every operator bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchgauge.operators import (
    anomaly, catalog, compare, configs, drift, impute, merge, metrics, package_import, replay, sketches,
    ticket_import, tickets, validate,
)
from batchgauge.functions.settings import with_option_defaults
from batchgauge.functions.text import parse_time
from batchgauge.operators.quantiles import EXACT_ROWS
from batchgauge.operators.slicing import ROWS_PER_SLICE, largest_group
from batchgauge.plans import bindings as b
from batchgauge.plans import process as run
from batchgauge.session import materialise
from batchgauge.sinks import exports, reports
from batchgauge.sources import csv_files, documents, integrity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PIECES = 8
"""The ``_sliced`` queries cut the largest group into this many slices at least, so the
path taken by groups that exceed a task also runs on small tables."""


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so results do not depend on the order of additions."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def cut_size(df: DataFrame, keys: list[str]) -> int:
    return max(1, min(ROWS_PER_SLICE, largest_group(df, keys) // PIECES))


# --- sources and validation ---------------------------------------------------------


@query
def csv_scan(spark, sf):
    lines = csv_files.file_lines(spark, b.write_csv_files(spark, sf))
    folder = r"day=(\d+)/part=(\d+)"
    keyed = lines.select(
        F.concat_ws("/", F.regexp_extract("file_path", folder, 1), F.regexp_extract("file_path", folder, 2)).alias("batch_id"),
        "row_number", "line",
    )
    return validate.readings_of(csv_files.scan(keyed))


@query
def file_contract(spark, sf):
    return validate.rejected_files(*b.user_files(spark, sf))


@query
def wide_to_long(spark, sf):
    return validate.wide_to_long(b.hour_grid(spark, sf), b.SENSORS)


@query
def long_to_wide(spark, sf):
    """The hour grid made long and wide again."""
    return validate.long_to_wide(validate.wide_to_long(b.hour_grid(spark, sf), b.SENSORS), b.SENSORS)


@query
def lenient_times(spark, sf):
    """Times in loose spellings, read both ways."""
    text = F.col("text")
    return b.loose_times(spark, sf).select("event_id", "text", parse_time(text).alias("strict"), parse_time(text, lenient=True).alias("lenient"))


def _scanned(spark, sf):
    return csv_files.scan(b.csv_lines(spark, sf))


@query
def err_column_mismatch(spark, sf):
    return validate.row_level_errors(_scanned(spark, sf), "column_mismatch")


@query
def err_missing_timestamp(spark, sf):
    return validate.row_level_errors(_scanned(spark, sf), "missing_timestamp")


@query
def err_invalid_timestamp(spark, sf):
    return validate.row_level_errors(_scanned(spark, sf), "invalid_timestamp")


@query
def err_non_numeric(spark, sf):
    return validate.cell_errors(_scanned(spark, sf))


@query
def row_errors(spark, sf):
    return validate.row_errors(_scanned(spark, sf))


@query
def clean_readings(spark, sf):
    return validate.readings_of(_scanned(spark, sf))


@query
def run_counters(spark, sf):
    rows = _scanned(spark, sf)
    return metrics.run_counters(impute.dedup_readings(validate.readings_of(rows)), validate.row_errors(rows))


@query
def source_summary(spark, sf):
    rows = _scanned(spark, sf)
    found = metrics.source_summary(validate.readings_of(rows), validate.row_errors(rows))
    return found.withColumn("columns", F.array_join("columns", ","))


@query
def error_type_counts(spark, sf):
    return anomaly.error_type_counts(validate.row_errors(_scanned(spark, sf)))


@query
def source_column_stats(spark, sf):
    return rounded(metrics.source_column_stats(b.readings(spark, sf)))


# --- cleaning and imputation --------------------------------------------------------


@query
def dedup_rows(spark, sf):
    """Wide rows of half a day each: the first row of every half stays."""
    half = F.expr("ts - make_dt_interval(0, hour(ts) % 12)")
    return impute.dedup_rows(b.hour_grid(spark, sf).withColumn("ts", half), b.SENSORS)


@query
def dedup_readings(spark, sf):
    return impute.dedup_readings(b.coarse_readings(spark, sf))


@query
def impute_interpolate(spark, sf):
    return rounded(impute.interpolate(b.readings(spark, sf, "long"), limit=3, fill=0.0))


@query
def impute_interpolate_sliced(spark, sf):
    readings = b.readings(spark, sf, "long")
    return rounded(impute.interpolate(readings, 3, 0.0, cut_size(readings, impute.SERIES)))


@query
def impute_fill(spark, sf):
    return impute.fill_constant(b.readings(spark, sf), 1.5)


@query
def impute_drop(spark, sf):
    return impute.drop_incomplete(validate.wide_to_long(b.hour_grid(spark, sf), b.SENSORS))


@query
def impute_ffill(spark, sf):
    return impute.fill_forward_back(b.readings(spark, sf, "long"))


@query
def impute_by_config(spark, sf):
    return rounded(impute.impute_by_config(b.readings(spark, sf, "long"), b.day_config(spark, sf)))


# --- metrics and anomalies ----------------------------------------------------------


def _stats(spark, sf, cut: bool = False):
    """Statistics of the de-duplicated, interpolated readings."""
    raw = b.readings(spark, sf)
    largest = largest_group(raw, impute.SERIES)
    rows = max(1, min(ROWS_PER_SLICE, largest // PIECES)) if cut else ROWS_PER_SLICE
    exact = rows if cut else EXACT_ROWS
    source = run.by_series(raw) if largest <= min(rows, exact) else raw
    filled = impute.interpolate(impute.dedup_readings(source), 5, 0.0, rows, raw, largest)
    return metrics.series_stats(filled, exact_rows=exact, largest=largest)


@query
def sensor_metrics(spark, sf):
    return rounded(metrics.metric_rows(_stats(spark, sf)))


@query
def sensor_metrics_sliced(spark, sf):
    return rounded(metrics.metric_rows(_stats(spark, sf, cut=True)))


def _line_readings(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("batch_id"),
        F.concat("l_returnflag", "l_linestatus").alias("flags"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )
    return lines.unpivot(["batch_id", "flags"], ["quantity", "price"], "kind", "value").select(
        "batch_id", F.concat_ws("_", "flags", "kind").alias("sensor"), "value"
    )


@query
def lineitem_metrics(spark, sf):
    readings = _line_readings(spark, sf)
    return rounded(metrics.metric_rows(metrics.series_stats(readings, stored=True)), 4)


@query
def metrics_by_config(spark, sf):
    result = run.process(b.readings(spark, sf), b.day_config(spark, sf))
    return rounded(result.metrics)


@query
def anomaly_zscore(spark, sf):
    readings = b.readings(spark, sf)
    return rounded(anomaly.zscore_anomalies(readings, metrics.series_moments(readings), 3.0))


@query
def anomaly_labels(spark, sf):
    """Display texts of the z-score anomalies."""
    readings = b.readings(spark, sf)
    none = F.lit(None).cast("double")
    label = anomaly.anomaly_label(F.col("score"), none, none, none.cast("string"))
    found = anomaly.zscore_anomalies(readings, metrics.series_moments(readings), 3.0)
    return found.select("batch_id", "sensor", "row_number", label.alias("label"))


@query
def anomaly_iqr(spark, sf):
    readings = b.readings(spark, sf)
    return rounded(anomaly.iqr_anomalies(readings, metrics.series_stats(readings, stored=True), 1.5))


@query
def anomaly_by_config(spark, sf):
    result = run.process(b.readings(spark, sf), b.day_config(spark, sf))
    return rounded(result.anomalies)


@query
def anomaly_by_config_sliced(spark, sf):
    readings = b.readings(spark, sf)
    rows = cut_size(readings, impute.SERIES)
    return rounded(run.process(readings, b.day_config(spark, sf), rows, rows).anomalies)


@query
def zscore_threshold_sweep(spark, sf):
    readings = b.readings(spark, sf)
    return anomaly.threshold_sweep(readings, metrics.series_moments(readings), [1.0, 1.5, 2.0, 3.0])


def _days(spark, sf):
    return b.day_config(spark, sf).select("batch_id")


def _counts(spark, sf):
    readings = b.readings(spark, sf)
    found = anomaly.zscore_anomalies(readings, metrics.series_moments(readings), 3.0)
    return anomaly.anomaly_counts(found, _days(spark, sf))


@query
def anomaly_counts(spark, sf):
    return _counts(spark, sf)


@query
def anomaly_range(spark, sf):
    return anomaly.anomaly_range(_counts(spark, sf))


@query
def sensors_with_anomalies(spark, sf):
    return anomaly.sensors_with_anomalies(_counts(spark, sf))


@query
def anomaly_kind_counts(spark, sf):
    result = run.process(b.readings(spark, sf), b.day_config(spark, sf))
    return anomaly.anomaly_kind_counts(result.anomalies)


# --- comparison ---------------------------------------------------------------------


def _metrics(spark, sf):
    return metrics.metric_rows(_stats(spark, sf))


def _stored_metrics(spark, sf):
    """Results of a run are stored tables; later steps read them instead of rerunning."""
    return materialise(_metrics(spark, sf))


@query
def cmp_metrics(spark, sf):
    return rounded(compare.metric_matrix(_metrics(spark, sf)))


@query
def cmp_metrics_wide(spark, sf):
    return rounded(compare.metric_matrix_wide(_stored_metrics(spark, sf)))


@query
def cmp_summary(spark, sf):
    return compare.matrix_summary(compare.metric_matrix(_metrics(spark, sf)))


@query
def cmp_top10(spark, sf):
    return rounded(compare.top_differences(compare.metric_matrix(_metrics(spark, sf)), 10))


@query
def cmp_anomalies_wide(spark, sf):
    return compare.anomaly_table(materialise(_counts(spark, sf)), _days(spark, sf))


@query
def metric_key_union(spark, sf):
    """Metric keys of the days and of the runs. Interpolation ends in a fill value, so it leaves the same readings
    known as filling alone, and readings of equal times have one sensor: neither changes a key."""
    imputed = impute.fill_constant(b.readings(spark, sf), 0.0)
    return compare.metric_keys(metrics.metric_keys(imputed), b.run_metric_keys(spark, sf))


@query
def batch_summaries(spark, sf):
    return compare.batch_summaries(
        b.batches(spark, sf).drop("config_version"), b.timed_runs(spark, sf),
        b.run_metrics(spark, sf), b.run_anomalies(spark, sf),
    )


@query
def cmp_metrics_blocks(spark, sf):
    """The metric matrix with a column per batch, in blocks of seven columns."""
    found = _stored_metrics(spark, sf)
    days = found.select("batch_id").distinct().select(F.col("batch_id").alias("name"), F.unix_date(F.col("batch_id").cast("date")).alias("place"))
    return rounded(reports.wide_blocks(found, ["sensor", "metric_name"], "batch_id", "metric_value", days, 7)[0])


@query
def cmp_document(spark, sf):
    """The comparison of all days as one JSON document, written and read again line by line: the lines
    with a mark for every number, and the sum of their numbers."""
    days = _days(spark, sf).withColumns({
        "batch_name": F.concat(F.lit("day "), "batch_id"), "locked": F.dayofmonth(F.col("batch_id").cast("date")) % 2 == 0})
    document = reports.comparison_fragments("days", "2025-01-01T00:00:00", days, _stored_metrics(spark, sf), materialise(_counts(spark, sf)), (7, "s", "1.0"))
    lines = spark.read.text(reports.write_document(b.new_folder(spark, "report"), document))
    number = r"(?<=:)-?[0-9][0-9.E+-]*(?=[,}]|$)"
    values = F.transform(F.regexp_extract_all("value", F.lit(f"({number})"), 1), lambda v: v.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return lines.select(F.regexp_replace("value", number, "#").alias("line"), F.round(total, 5).alias("numbers"))


@query
def sketch_errors(spark, sf):
    """Quartiles from sketches of two halves of every series, merged: whether their ranks are within
    the stated bound."""
    readings = b.readings(spark, sf)
    halves = materialise(sketches.series_sketches(readings.withColumn("half", F.col("row_number") % 2), ["half", *impute.SERIES]))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = sketches.sketch_quantiles(materialise(sketches.merged(halves, impute.SERIES)), shares)
    errors = sketches.measured_error(readings, found, shares)
    # of the two values next to a share either may be taken: one value more
    bound = sketches.rank_error() + 1 / F.col("n")
    return errors.select(*impute.SERIES, "n", *[(F.col(f"{q}_error") <= bound).alias(f"{q}_within") for q in shares])


@query
def fingerprint_tree(spark, sf):
    """Tree digests of the day files, with a hundred lines to a block."""
    found = integrity.tree_digests(spark, b.write_csv_files(spark, sf), 100)
    day = F.regexp_extract("file_path", r"day=(\d+)", 1)
    return found.where("file_name LIKE 'part-%'").select(day.alias("day"), "file_size", "lines", "tree_sha256")


@query
def baseline_package(spark, sf):
    """A package of all baselines, written, checked and read again: rows of each part."""
    chosen = b.baselines(spark, sf).join(
        b.batches(spark, sf).select(F.col("batch_id").alias("baseline_id"), "config_json"), "baseline_id").withColumn("source_batch_id", F.col("baseline_id"))
    thresholds = drift.build_thresholds(b.run_metrics(spark, sf)).withColumn("baseline_id", F.col("run_id") % 100)
    summary = b.numbered_runs(spark, sf).groupBy("batch_id").agg(F.sum("rows_processed").alias("total_rows"))
    path = exports.write_package(b.new_folder(spark, "package"), exports.baseline_package(
        chosen, thresholds, b.baseline_checks(spark, sf), newest_checks=5, source_summary=summary))
    read = documents.read_package(spark, path, integrity.BASELINE_FILES)
    counts = [table.agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("baseline_id").alias("ids"),
        (F.sum("check_history_count") if part == "baseline_summary" else F.sum("total_rows") if part == "source_summary" else F.lit(None).cast("bigint")).alias("total"))
        for part, table in sorted(read.items())]
    return reduce(DataFrame.unionByName, counts)


# --- drift --------------------------------------------------------------------------


def _baseline(spark, sf):
    """Thresholds of the first day, and requests to check every later day against it."""
    found = _stored_metrics(spark, sf)
    days = materialise(_days(spark, sf))
    first = days.agg(F.min("batch_id").alias("batch_id"))
    thresholds = drift.build_thresholds(found.join(first, "batch_id", "left_semi")).select(
        F.lit(1).cast("bigint").alias("baseline_id"), "sensor", "metric_name", "baseline_value",
        "warn_pct", "block_pct", "warn_min", "warn_max", "block_min", "block_max",
    )
    requests = days.join(first, "batch_id", "left_anti").select(
        F.lit(1).cast("bigint").alias("baseline_id"), "batch_id"
    )
    return thresholds, found, requests


@query
def baseline_thresholds(spark, sf):
    return rounded(drift.build_thresholds(_metrics(spark, sf), 5.0, 15.0), 7)


@query
def drift_check(spark, sf):
    return rounded(drift.drift_check(*_baseline(spark, sf)))


@query
def drift_check_by_name(spark, sf):
    return rounded(drift.drift_check_by_name(*_baseline(spark, sf)))


def _verdict(spark, sf):
    thresholds, found, requests = _baseline(spark, sf)
    return drift.drift_verdict(drift.drift_check(thresholds, found, requests), requests)


@query
def drift_overall(spark, sf):
    return _verdict(spark, sf)


@query
def baseline_eligible(spark, sf):
    return drift.registration_decisions(
        b.baseline_requests(spark, sf), b.batches(spark, sf), b.runs(spark, sf), b.baselines(spark, sf)
    )


@query
def baseline_last_check(spark, sf):
    return drift.last_checks(b.baseline_checks(spark, sf)).drop("newest_rank")


@query
def raise_tickets(spark, sf):
    opened = _days(spark, sf).where(F.dayofmonth(F.col("batch_id").cast("date")) % 3 == 0).select(
        "batch_id", F.lit("baseline_blocked").alias("trigger_rule")
    )
    return tickets.raise_tickets(_verdict(spark, sf), _counts(spark, sf), opened, 4)


# --- replay -------------------------------------------------------------------------


def _replay(spark, sf):
    raw = b.readings(spark, sf, "long")
    largest = largest_group(raw, impute.SERIES)

    def measured(filled):
        return metrics.metric_rows(metrics.series_stats(filled, largest=largest))

    stored = measured(impute.interpolate(raw, 3, 0.0, largest=largest))
    # the second run has another configuration, without the range: one-sided rows
    options = with_option_defaults(raw.select("batch_id").distinct().withColumn("compute_range", F.lit(False)))
    again = metrics.metrics_by_config(metrics.series_stats(impute.fill_forward_back(raw, largest=largest), largest=largest), options)
    return replay.replay_comparison(stored, again, 5.0)


@query
def replay_diff(spark, sf):
    return rounded(replay.replay_differences(_replay(spark, sf)))


@query
def replay_first20(spark, sf):
    return rounded(replay.first_differences(replay.replay_differences(_replay(spark, sf)), 20))


@query
def replay_verdict(spark, sf):
    return replay.replay_verdict(_replay(spark, sf))


@query
def even_sample(spark, sf):
    return replay.even_sample(b.readings(spark, sf), 10)


@query
def even_sample_sliced(spark, sf):
    readings = b.readings(spark, sf)
    return replay.even_sample(readings, 10, cut_size(readings, ["batch_id"]))


@query
def manifest_summary(spark, sf):
    return replay.manifest_summary(
        b.numbered_runs(spark, sf), b.run_metrics(spark, sf), b.run_anomalies(spark, sf), b.run_errors(spark, sf)
    )


def _snapshot(spark, sf, run_metrics=None):
    batches = b.batches(spark, sf)
    runs = b.numbered_runs(spark, sf).join(batches.select("batch_id", "config_json"), "batch_id")
    if run_metrics is None:
        run_metrics = b.run_metrics(spark, sf)
    return replay.snapshot_manifest(runs, batches, run_metrics, b.run_anomalies(spark, sf), b.run_errors(spark, sf))


def _snapshot_parts(spark, sf):
    """Parts of a package of all runs; manifest and package read the metrics from one stored table."""
    run_metrics = materialise(b.run_metrics(spark, sf))
    manifest = materialise(_snapshot(spark, sf, run_metrics))
    lines = manifest.groupBy("batch_id").agg(F.sum("rows_processed").alias("total_rows"))
    return exports.snapshot_package(
        manifest, run_metrics, b.run_anomalies(spark, sf), b.run_errors(spark, sf), lines, {"pyspark": spark.version})


@query
def snapshot_manifest(spark, sf):
    def shown(kinds):
        return F.array_join(F.transform(kinds, lambda k: F.concat_ws("=", k["kind"], k["n"].cast("string"))), ",").alias(kinds)

    return _snapshot(spark, sf).select(
        "run_id", "batch_name", "run_number", "config_sha256", "total_metrics", "total_anomalies", "total_errors",
        shown("anomaly_type_counts"), shown("error_type_counts"),
    )


@query
def snapshot_package(spark, sf):
    """A package of all runs, written, checked and read again: rows and contents of each part."""
    parts = _snapshot_parts(spark, sf)
    path = exports.write_package(b.new_folder(spark, "package"), parts)
    read = documents.read_package(spark, path, integrity.SNAPSHOT_FILES)
    held = {
        "manifest": F.sum("total_metrics"), "config": F.sum(F.length("config_json")), "metrics": F.sum("metric_value"),
        "anomalies": F.sum("value"), "errors": F.sum("row_number"), "source_summary": F.sum("total_rows"), "dependencies": F.lit(0)}
    counts = [table.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.round(held[part].cast("double"), 3).alias("total"))
              for part, table in sorted(read.items())]
    return reduce(DataFrame.unionByName, counts)


def _baseline_registry(spark, sf):
    return b.baselines(spark, sf).select(F.col("baseline_id").alias("id"), "name")


def _baselines_imported(spark, sf, policy):
    """A package of one baseline per customer, some of whose names are taken, read and imported."""
    chosen = b.batches(spark, sf).select(
        F.col("batch_id").alias("baseline_id"), F.concat(F.lit("base_"), F.col("batch_id").cast("string")).alias("name"),
        F.col("batch_id").alias("source_batch_id"), "config_json")
    thresholds = drift.build_thresholds(b.run_metrics(spark, sf)).withColumn("baseline_id", F.col("run_id") % 100)
    path = exports.write_package(b.new_folder(spark, "package"), exports.baseline_package(chosen, thresholds, b.baseline_checks(spark, sf)))
    read = documents.read_package(spark, path, integrity.BASELINE_FILES)
    return package_import.import_baselines(_baseline_registry(spark, sf), read, policy, "/packages/base")


@query
def baseline_import_rename(spark, sf):
    """Imported baselines with the number of their thresholds."""
    made = _baselines_imported(spark, sf, "rename")
    counts = made["metric_thresholds"].groupBy("baseline_id").agg(F.count(F.lit(1)).alias("thresholds"))
    return made["baselines"].join(counts, "baseline_id", "left").fillna(0, ["thresholds"])


@query
def baseline_import_audit(spark, sf):
    return _baselines_imported(spark, sf, "reject")["audit_log"]


@query
def snapshot_import(spark, sf):
    """A package of all runs imported twice as far as names are free: metrics under the new ids."""
    parts = _snapshot_parts(spark, sf)
    read = documents.read_package(spark, exports.write_package(b.new_folder(spark, "package"), parts), integrity.SNAPSHOT_FILES)
    taken = b.numbered_runs(spark, sf).where("run_number = 1").join(b.batches(spark, sf).select("batch_id", "batch_name"), "batch_id").select(
        F.col("run_id").alias("id"), F.concat(F.col("batch_name"), F.lit(" #1")).alias("name"))
    made = package_import.import_snapshots(taken, read, "skip", "/packages/runs")
    held = made["metrics"].groupBy("run_id").agg(F.count(F.lit(1)).alias("metrics"), F.round(F.sum("metric_value"), 6).alias("total"))
    return made["snapshots"].select("run_id", "name", "original_name", "original_id").join(held, "run_id", "left")


@query
def run_records(spark, sf):
    """A run over the scanned lines: processed rows after cleaning and imputation, and errors."""
    rows = materialise(_scanned(spark, sf))
    readings = validate.readings_of(rows)
    options = with_option_defaults(readings.select("batch_id").distinct())
    return run.process(readings, options, errors=validate.row_errors(rows)).runs


# --- exports ------------------------------------------------------------------------


@query
def export_metrics(spark, sf):
    return rounded(exports.metrics_export(b.run_metrics(spark, sf), b.numbered_runs(spark, sf), b.batches(spark, sf)))


@query
def export_errors(spark, sf):
    return exports.errors_export(b.run_errors(spark, sf), b.numbered_runs(spark, sf), b.batches(spark, sf))


@query
def export_anomalies(spark, sf):
    return exports.anomalies_export(b.run_anomalies(spark, sf), b.numbered_runs(spark, sf), b.batches(spark, sf))


@query
def ticket_export_docs(spark, sf):
    notes = b.ticket_events(spark, sf).where("action <> 'create'").select(
        "ticket_id", F.col("seq").alias("note_id"), F.lit(None).cast("string").alias("author"),
        F.col("action").alias("note_type"), F.col("payload").alias("content"), "created_at",
    )
    documents = tickets.ticket_documents(b.tickets(spark, sf), notes)
    return documents.select(
        "ticket_id", "title", "status", "original_ticket_id", "part", "notes_before",
        F.array_join(F.transform("notes", lambda n: F.concat_ws("|", n["note_type"], n["content"], n["created_at"])), ";").alias("timeline"),
    )


@query
def scheme_files(spark, sf):
    """Schemes written as exchange documents and read again."""
    path = exports.write_json(exports.scheme_documents(b.schemes(spark, sf)), b.new_folder(spark, "schemes"))
    return documents.read_schemes(spark, path, lines=True).select("name", "scheme_version", "config", "source_scheme_id", "original_id")


@query
def ticket_file_timelines(spark, sf):
    """Tickets written as exchange documents with their notes, read again: the timeline of every ticket."""
    notes = b.ticket_events(spark, sf).where("action <> 'create'").select(
        "ticket_id", F.col("seq").alias("note_id"), F.lit("desk").alias("author"), F.col("action").alias("note_type"),
        F.col("payload").alias("content"), "created_at")
    path = exports.write_json(tickets.ticket_documents(b.tickets(spark, sf), notes), b.new_folder(spark, "tickets"))
    parts = documents.read_ticket_parts(spark, path, lines=True)
    told = documents.ticket_notes(parts, "title").groupBy("title").agg(
        F.count(F.lit(1)).alias("notes"), F.max("seq").alias("last"), F.max_by("content", "seq").alias("last_note"),
        F.min_by("note_type", "seq").alias("first_type"))
    read = documents.read_tickets(spark, path, lines=True).select("title", "status", "source_batch_id", "source_run_id", "assignee", "original_ticket_id")
    return read.join(told, "title", "left")


@query
def first_errors(spark, sf):
    """The first two row errors of every run: how many, and the sum of their rows (rows may have two)."""
    first = replay.capped(b.run_errors(spark, sf), "run_id", "row_number", 2)
    return first.groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"), F.sum("row_number").alias("rows"))


# --- configurations -----------------------------------------------------------------


@query
def eligible_batches(spark, sf):
    return catalog.eligible_batches(b.batches(spark, sf)).select("batch_id", "batch_name")


@query
def config_missing_fields(spark, sf):
    return configs.missing_fields(b.schemes(spark, sf))


@query
def version_compat(spark, sf):
    return configs.version_check(b.schemes(spark, sf))


@query
def config_diff(spark, sf):
    """Each history entry against the configuration its batch has now."""
    pairs = b.config_history(spark, sf).select("id", "batch_id", F.col("config_json").alias("old_json")).join(
        b.batches(spark, sf).select("batch_id", F.col("config_json").alias("new_json")), "batch_id"
    )
    return configs.config_diff(pairs, ["id"])


@query
def config_diff_shapes(spark, sf):
    """Pairs of documents in several shapes."""
    return configs.config_diff(b.shaped_configs(spark, sf), ["id"])


@query
def scheme_lineage(spark, sf):
    return configs.scheme_lineage(b.schemes(spark, sf))


@query
def apply_precheck(spark, sf):
    checked = configs.apply_precheck(b.apply_requests(spark, sf), b.batches(spark, sf), b.schemes(spark, sf))
    return checked.select(
        "request_id", "batch_id", "scheme_id", "scheme_name", "source_scheme_name",
        F.array_join(F.col("risks.risk"), ",").alias("risks"), "can_proceed", "current_version", "new_version",
    )


@query
def rollback_precheck(spark, sf):
    requests = b.apply_requests(spark, sf).select("batch_id").distinct()
    checked = configs.rollback_precheck(requests, b.batches(spark, sf), b.config_history(spark, sf))
    return checked.select(
        "batch_id", F.array_join(F.col("risks.risk"), ",").alias("risks"), "can_proceed", "new_version"
    )


def _applied(spark, sf, action):
    return configs.apply_schemes(
        b.apply_requests(spark, sf), b.batches(spark, sf), b.schemes(spark, sf), b.config_history(spark, sf), action
    )


@query
def apply_schemes(spark, sf):
    return _applied(spark, sf, "apply")["config_history"].select(
        "request_id", "batch_id", "scheme_id", "scheme_name", "source_scheme_id", "config_version", "config_json", "action"
    )


@query
def apply_schemes_audit(spark, sf):
    audit = _applied(spark, sf, "apply")["audit_log"]
    return audit.select(
        "request_id", "batch_id", "scheme_id", "result", "previous_config_json", "new_config_json",
        F.coalesce(F.size("config_diff"), F.lit(0)).alias("changes"), "version_regressed",
    )


@query
def derive_apply_schemes(spark, sf):
    return _applied(spark, sf, "derive_apply")["schemes"]


@query
def rollback_targets(spark, sf):
    return configs.rollback_targets(b.config_history(spark, sf)).select(
        "batch_id", "latest_id", "latest_config_version", "target_id", "target_scheme_name", "target_config_version"
    )


@query
def apply_rollback(spark, sf):
    requests = b.batches(spark, sf).select("batch_id")
    return configs.apply_rollback(requests, b.batches(spark, sf), b.config_history(spark, sf))


def _rolled_back(spark, sf):
    batches = b.batches(spark, sf)
    return configs.roll_back(batches.select("batch_id"), batches, b.config_history(spark, sf))


@query
def rollback_audit(spark, sf):
    audit = _rolled_back(spark, sf)["audit_log"].withColumn("changes", F.coalesce(F.size("config_diff"), F.lit(0)))
    return audit.drop("config_diff", "request_id")


@query
def rollback_batches(spark, sf):
    return _rolled_back(spark, sf)["batches"]


@query
def apply_dry_run(spark, sf):
    """Every request as a dry run."""
    checked = configs.apply_precheck(b.apply_requests(spark, sf), b.batches(spark, sf), b.schemes(spark, sf))
    audit = configs.dry_run_audit(checked).withColumn("changes", F.coalesce(F.size("config_diff"), F.lit(0)))
    return audit.drop("config_diff", "error_message")


@query
def last_change(spark, sf):
    found = configs.last_change(
        b.batches(spark, sf), b.audit_log(spark, sf), b.schemes(spark, sf), b.config_history(spark, sf)
    )
    changed = F.coalesce(F.array_join(F.col("config_diff.path"), ","), F.lit(""))
    return found.withColumn("changed", changed).drop("config_diff")


@query
def history_seed(spark, sf):
    return configs.history_seed(b.batches(spark, sf), b.config_history(spark, sf))


# --- runs and listings --------------------------------------------------------------


@query
def latest_run(spark, sf):
    return catalog.latest_run(b.runs(spark, sf))


@query
def latest_successful_run(spark, sf):
    return catalog.latest_run(b.runs(spark, sf), "success")


@query
def run_numbers(spark, sf):
    return b.numbered_runs(spark, sf).select("run_id", "batch_id", "run_number")


@query
def run_numbers_appended(spark, sf):
    """Numbers of the runs of even orders, going on behind those of the odd ones."""
    runs = b.runs(spark, sf)
    stored = catalog.number_runs(runs.where("run_id % 2 = 1"))
    return catalog.append_numbers(stored, runs.where("run_id % 2 = 0")).select("run_id", "batch_id", "run_number")


@query
def batch_status(spark, sf):
    return catalog.batch_status(b.batches(spark, sf), b.runs(spark, sf))


@query
def audit_query(spark, sf):
    return catalog.newest_first(b.audit_log(spark, sf), 100, action="apply", result="failed")


@query
def ticket_list(spark, sf):
    return catalog.newest_first(b.tickets(spark, sf), 100, "ticket_id", status="open", assignee="BUILDING")


@query
def listing_runs(spark, sf):
    return catalog.listing(b.runs(spark, sf), ["run_id", "batch_id", "run_status"], F.desc("run_id"))


# --- merge and tickets --------------------------------------------------------------


def _merge(spark, sf, policy):
    return merge.merge_decisions(b.named_rows(spark, sf), b.incoming_names(spark, sf), policy)


@query
def merge_reject(spark, sf):
    return _merge(spark, sf, "reject")


@query
def merge_skip(spark, sf):
    return _merge(spark, sf, "skip")


@query
def merge_overwrite(spark, sf):
    """The merged table itself: overwritten rows keep their id."""
    existing = b.named_rows(spark, sf).withColumns({
        "config": F.lit("old"), "original_id": F.lit(None).cast("bigint")})
    incoming = b.incoming_names(spark, sf).withColumns({
        "config": F.concat(F.lit("new "), F.col("seq").cast("string")), "original_id": F.col("seq")})
    decisions = merge.merge_decisions(existing, incoming, "overwrite")
    return merge.merged_table(existing, incoming, decisions, ["config"])


@query
def merge_rename(spark, sf):
    return _merge(spark, sf, "rename")


@query
def merge_rename_sliced(spark, sf):
    incoming = b.incoming_names(spark, sf)
    return merge.merge_decisions(b.named_rows(spark, sf), incoming, "rename", cut_size(incoming, ["name"]))


@query
def ticket_state(spark, sf):
    return tickets.ticket_state(b.ticket_events(spark, sf))


@query
def ticket_state_sliced(spark, sf):
    events = b.ticket_events(spark, sf)
    return tickets.ticket_state(events, cut_size(events, ["ticket_id"]))


@query
def ticket_illegal(spark, sf):
    return tickets.illegal_events(b.ticket_events(spark, sf))


@query
def ticket_conflicts(spark, sf):
    return tickets.ticket_conflicts(b.incoming_tickets(spark, sf), b.tickets(spark, sf))


@query
def ticket_import_reject(spark, sf):
    return ticket_import.import_decisions(b.tickets(spark, sf), b.ticket_files(spark, sf), "reject")


@query
def ticket_import_rename(spark, sf):
    return ticket_import.import_decisions(b.tickets(spark, sf), b.ticket_files(spark, sf), "rename")


def _imported(spark, sf):
    return ticket_import.import_tickets(b.tickets(spark, sf), b.ticket_files(spark, sf), b.ticket_file_notes(spark, sf), "reject")


@query
def ticket_import_rows(spark, sf):
    """The tickets that an import adds, with the size of their timelines."""
    made = _imported(spark, sf)
    notes = made["ticket_notes"].groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("notes"), F.max_by("content", "place").alias("last_note"), F.min_by("content", "place").alias("first_note"),
        F.count_if(F.col("note_type") == "resolve").alias("resolving"))
    return made["tickets"].join(notes, "ticket_id")


@query
def ticket_import_audit(spark, sf):
    return _imported(spark, sf)["audit_log"]
