"""Cross-batch comparison of metrics and anomaly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.catalog import latest_run

METRIC = ["sensor", "metric_name"]


def _differences(spread: DataFrame) -> DataFrame:
    several = F.col("batches") >= 2
    diff = F.when(several, F.col("max_value") - F.col("min_value"))
    rel = F.when(
        several & (F.col("min_value") != 0),
        (F.col("max_value") - F.col("min_value")) / F.nullif(F.abs("min_value"), F.lit(0.0)) * 100,
    )
    return spread.withColumns({"abs_diff": diff, "rel_diff_pct": rel})


def _spread() -> list:
    return [
        F.count("metric_value").alias("batches"),
        F.min("metric_value").alias("min_value"),
        F.max("metric_value").alias("max_value"),
    ]


def metric_matrix(metrics: DataFrame) -> DataFrame:
    """Spread of each metric over the batches: largest minus smallest, also in percent of
    the smallest (NULL when that is 0 or fewer than two batches have the metric).

    Grouping gives the union of the metric keys; no join between batches takes place.
    """
    return _differences(metrics.groupBy(*METRIC).agg(*_spread()))


def metric_matrix_wide(metrics: DataFrame) -> DataFrame:
    """The matrix as a table with one column per batch (``value_<batch>``)."""
    named = metrics.withColumn("column", F.concat(F.lit("value_"), "batch_id"))
    values = named.groupBy(*METRIC).pivot("column").agg(F.max("metric_value"))
    return values.join(
        metric_matrix(metrics).select(*METRIC, "abs_diff", "rel_diff_pct"), METRIC
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count(F.lit(1)).alias("total_metrics_compared"),
        F.count_if((F.col("abs_diff") > 0) & ~F.isnan("abs_diff")).alias("metrics_with_diff"),
    )


def top_differences(matrix: DataFrame, limit: int = 10) -> DataFrame:
    """The metrics that differ most, largest absolute difference first."""
    return (
        matrix.where((F.col("abs_diff") > 0) & ~F.isnan("abs_diff"))
        .orderBy(F.desc("abs_diff"), *METRIC)
        .limit(limit)
    )


def metric_keys(*sides: DataFrame) -> DataFrame:
    """All metric keys that occur on any side."""
    keys = [side.select(*METRIC) for side in sides]
    union = keys[0]
    for other in keys[1:]:
        union = union.unionByName(other)
    return union.distinct()


def anomaly_table(counts: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per batch, its total and one column per sensor that has anomalies."""
    named = counts.where(F.col("sensor").isNotNull()).withColumn(
        "column", F.concat(F.lit("anomalies_"), "sensor")
    )
    per_sensor = named.groupBy("batch_id").pivot("column").agg(F.max("anomalies"))
    totals = counts.where(F.col("sensor").isNull()).select(
        "batch_id", F.col("anomalies").alias("total_anomalies")
    )
    return batches.join(totals, "batch_id").join(per_sensor, "batch_id", "left").fillna(0)


def batch_summaries(
    batches: DataFrame,
    runs: DataFrame,
    metrics: DataFrame,
    anomalies: DataFrame,
    status: str | None = None,
) -> DataFrame:
    """Each batch with its latest run, that run's metric and anomaly counts, and when it was
    processed: ``finished_at`` of the run, else ``started_at``, NULL where runs have neither."""
    latest = latest_run(runs, status)
    times = [F.col(c) for c in ("finished_at", "started_at") if c in runs.columns]
    found = [
        rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
        for rows, name in ((metrics, "metrics_count"), (anomalies, "anomalies_count"))
    ]
    summary = batches.join(latest, "batch_id")
    for counts in found:
        summary = summary.join(counts, "run_id", "left")
    return summary.fillna(0, ["metrics_count", "anomalies_count"]).select(
        "batch_id",
        "batch_name",
        "status",
        "locked",
        F.element_at(F.split("source_file", "/"), -1).alias("source_file"),
        "config_version",
        "run_id",
        "run_number",
        "rows_processed",
        "rows_errors",
        "anomalies_count",
        "metrics_count",
        (F.coalesce(*times) if times else F.lit(None).cast("timestamp_ntz")).alias("processed_at"),
    )
