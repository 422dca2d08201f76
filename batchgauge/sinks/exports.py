"""Export tables and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.catalog import latest_run
from batchgauge.operators.drift import last_checks
from batchgauge.operators.replay import capped
from batchgauge.sources.integrity import CHECKSUMS, package_files

RUN = ["batch_id", "batch_name", "run_id", "run_number", "config_version"]
METRICS = ["sensor", "metric", "value"]
ERRORS = ["row_number", "error_type", "error_detail", "raw_data"]
ANOMALIES = ["sensor", "row_number", "timestamp", "value", "anomaly_type"]


def _of_runs(rows: DataFrame, runs: DataFrame, batches: DataFrame, columns: list[str], run_ids: DataFrame | None) -> DataFrame:
    chosen = latest_run(runs) if run_ids is None else runs.join(run_ids, "run_id", "left_semi")
    described = chosen.join(batches.select("batch_id", "batch_name"), "batch_id").select(*RUN)
    return rows.join(described, "run_id").select(*RUN, *columns)


def metrics_export(metrics: DataFrame, runs: DataFrame, batches: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    """Metrics of the given runs, by default of the newest run of each batch."""
    named = metrics.withColumnsRenamed({"metric_name": "metric", "metric_value": "value"})
    return _of_runs(named, runs, batches, METRICS, run_ids)


def errors_export(errors: DataFrame, runs: DataFrame, batches: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    return _of_runs(errors, runs, batches, ERRORS, run_ids)


def anomalies_export(anomalies: DataFrame, runs: DataFrame, batches: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    named = anomalies.withColumnRenamed("ts", "timestamp")
    return _of_runs(named, runs, batches, ANOMALIES, run_ids)


def write_csv(table: DataFrame, path: str, by_batch: bool = False) -> str:
    """CSV with a header. One folder per batch on request; without it an empty table still
    leaves a file with the header."""
    writer = table.write.mode("error").option("header", "true")
    if by_batch:
        writer = writer.partitionBy("batch_id")
    writer.csv(path)
    return path


def require_rows(table: DataFrame, what: str) -> DataFrame:
    if table.isEmpty():
        raise ValueError(f"no {what} to export")
    return table


def comparison_document(name: str, summaries: DataFrame, matrix: DataFrame, spread: DataFrame) -> DataFrame:
    """The report as JSON lines: a header line, then one line per batch and per metric.

    Lines instead of one nested object keep a report over any number of batches out of a
    single row.
    """
    head = spread.select(F.lit("report").alias("part"), F.to_json(F.struct(F.lit(name).alias("name"), F.struct("*").alias("anomalies"))).alias("value"))
    rows = summaries.select(F.lit("batch").alias("part"), F.to_json(F.struct("*")).alias("value"))
    keys = matrix.select(F.lit("metric").alias("part"), F.to_json(F.struct("*")).alias("value"))
    return head.unionByName(rows).unionByName(keys)


def write_comparison(path: str, document: DataFrame) -> str:
    document.write.mode("error").partitionBy("part").text(path)
    return path


def write_comparison_csv(path: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """The report as CSV tables, one folder each: summary, batches, metrics, anomalies and
    the range of the anomaly totals."""
    expected = {"summary", "batches", "metrics", "anomalies", "range"}
    if set(tables) != expected:
        raise ValueError(f"expected the tables {sorted(expected)}")
    return {name: write_csv(table, f"{path}/{name}") for name, table in tables.items()}


def comparison_summary(name: str, batches: DataFrame, scheme: tuple[str, str] | None = None) -> DataFrame:
    """The header row of a report over at least two batches."""
    row = batches.agg(
        F.lit(name).alias("report_name"),
        F.lit(scheme[0] if scheme else None).cast("string").alias("scheme_name"),
        F.lit(scheme[1] if scheme else None).cast("string").alias("scheme_version"),
        F.count(F.lit(1)).alias("batch_count"),
    )
    enough = F.when(F.col("batch_count") >= 2, F.col("batch_count")).otherwise(
        F.raise_error(F.lit("a comparison needs at least 2 batches"))
    )
    return row.withColumn("batch_count", enough)


def scheme_documents(schemes: DataFrame) -> DataFrame:
    return schemes.select(
        "name", "scheme_version", F.col("config_json").alias("config"), "source_scheme_id",
        F.coalesce("original_id", "scheme_id").alias("original_id"),
    )


def write_json(table: DataFrame, path: str) -> str:
    table.write.mode("error").json(path)
    return path


def snapshot_package(
    manifest: DataFrame, metrics: DataFrame, anomalies: DataFrame, errors: DataFrame,
    source_summary: DataFrame, dependencies: dict[str, str],
) -> dict[str, DataFrame]:
    """Parts of the package of the runs in ``manifest`` (``replay.snapshot_manifest``), whole."""
    chosen = manifest.select("run_id")
    spark = manifest.sparkSession
    return {
        "manifest": manifest,
        "config": manifest.select("run_id", "config_json", "config_sha256"),
        **{name: rows.join(chosen, "run_id", "left_semi")
           for name, rows in (("metrics", metrics), ("anomalies", anomalies), ("errors", errors))},
        "source_summary": source_summary.join(manifest.select("batch_id").distinct(), "batch_id", "left_semi"),
        "dependencies": spark.createDataFrame(sorted(dependencies.items()), "name STRING, version STRING"),
    }


def write_package(path: str, parts: dict[str, DataFrame]) -> str:
    """A folder per part, and the size and checksum of every file written in part ``checksum``."""
    for part, table in parts.items():
        table.write.mode("error").parquet(f"{path}/{part}")
    spark = next(iter(parts.values())).sparkSession
    package_files(spark, path).select("file_name", "file_size", "sha256").write.mode("error").json(f"{path}/{CHECKSUMS}")
    return path


def write_result_set(path: str, parts: dict[str, DataFrame], caps: dict[str, tuple[str, str, int]] | None = None) -> str:
    """A stored result set: every part as Parquet; ``caps`` names parts that also get a
    shortened copy for the manifest (``part -> (group column, order column, rows)``)."""
    for part, table in parts.items():
        table.write.mode("error").parquet(f"{path}/{part}")
    for part, (key, order, rows) in (caps or {}).items():
        capped(parts[part], key, order, rows).write.mode("error").parquet(f"{path}/manifest_{part}")
    return path


def baseline_package(
    baselines: DataFrame, thresholds: DataFrame, checks: DataFrame, newest_checks: int | None = None,
    source_summary: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Parts of a baseline package, with all checks of its baselines and their number.

    ``baselines``: one row each, with ``config_json`` if they have a configuration. ``source_summary``:
    ``batch_id`` and the summary of its source (``metrics.source_summary``), taken for the batch a baseline
    names as ``source_batch_id``. Both parts are written whether or not there is anything in them, so the
    package passes its check. ``newest_checks`` asks for a further part of that name with that many checks
    of each baseline.
    """
    chosen = baselines.select("baseline_id")
    history = checks.join(chosen, "baseline_id", "left_semi")
    totals = history.groupBy("baseline_id").agg(F.count(F.lit(1)).alias("check_history_count"))
    config = F.col("config_json") if "config_json" in baselines.columns else F.lit(None).cast("string")
    if source_summary is not None and "source_batch_id" in baselines.columns:
        named = baselines.select("baseline_id", F.col("source_batch_id").alias("batch_id"))
        source = named.join(source_summary, "batch_id").select("baseline_id", *source_summary.columns)
    else:
        source = chosen.select("baseline_id", F.lit(None).cast("string").alias("batch_id")).limit(0)
    parts = {
        "baseline_summary": baselines.drop("config_json").join(totals, "baseline_id", "left").fillna(0, ["check_history_count"]),
        "config": baselines.select("baseline_id", config.alias("config_json")).where("config_json IS NOT NULL"),
        "metric_thresholds": thresholds.join(chosen, "baseline_id", "left_semi"),
        "source_summary": source,
        "check_history": history,
    }
    if newest_checks is not None:
        parts["newest_checks"] = last_checks(history, newest_checks).drop("newest_rank")
    return parts
