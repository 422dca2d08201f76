"""Baselines: thresholds, drift checks, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.catalog import newest
from batchgauge.operators.slicing import stored_small

# Half-widths of the band around a baseline value of zero.
ZERO_WARN = 0.01
ZERO_BLOCK = 0.1

KEY = ["sensor", "metric_name"]


def build_thresholds(
    metrics: DataFrame,
    warn_pct: float = 5.0,
    block_pct: float = 15.0,
    custom: DataFrame | None = None,
) -> DataFrame:
    """Warning and blocking band of every metric of the baseline run.

    ``custom`` (``sensor, metric_name, warn_pct, block_pct``) replaces the default
    percentages where it has a row.
    """
    rows = metrics.where(F.col("metric_value").isNotNull()).withColumnRenamed(
        "metric_value", "baseline_value"
    )
    warn, block = F.lit(float(warn_pct)), F.lit(float(block_pct))
    if custom is not None:
        own = custom.select(*KEY, F.col("warn_pct").alias("_w"), F.col("block_pct").alias("_b"))
        rows = rows.join(own, KEY, "left")
        warn, block = F.coalesce("_w", warn), F.coalesce("_b", block)
    rows = rows.withColumns({"warn_pct": warn, "block_pct": block})
    base, zero = F.col("baseline_value"), F.col("baseline_value") == 0

    def band(pct: str, around_zero: float) -> Column:
        return F.when(zero, around_zero).otherwise(F.abs(base) * (F.col(pct) / 100.0))

    return rows.withColumns({"_warn": band("warn_pct", ZERO_WARN), "_block": band("block_pct", ZERO_BLOCK)}).select(
        *[c for c in metrics.columns if c != "metric_value"],
        "baseline_value", "warn_pct", "block_pct",
        (base - F.col("_warn")).alias("warn_min"), (base + F.col("_warn")).alias("warn_max"),
        (base - F.col("_block")).alias("block_min"), (base + F.col("_block")).alias("block_max"),
    )


def _judged(pairs: DataFrame) -> DataFrame:
    base, diff = F.col("baseline_value"), F.col("metric_value") - F.col("baseline_value")
    rel = F.when(base == 0, F.when(diff == 0, 0.0).otherwise(100.0)).otherwise(
        diff / F.nullif(F.abs(base), F.lit(0.0)) * 100
    )
    status = (
        F.when(F.abs("relative_pct") <= F.col("warn_pct"), "pass")
        .when(F.abs("relative_pct") <= F.col("block_pct"), "warn")
        .otherwise("block")
    )
    return (
        pairs.withColumns({"absolute_diff": diff, "relative_pct": rel})
        .withColumn("status", status)
        .withColumnRenamed("metric_value", "actual_value")
    )


def _expected(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests with the limits of their baseline; the limits are broadcast if they were measured small."""
    return requests.join(stored_small(limits), "baseline_id")


def drift_check(thresholds: DataFrame, metrics: DataFrame, requests: DataFrame) -> DataFrame:
    """Compare target runs with baselines, metric by metric.

    ``requests``: ``baseline_id, batch_id`` pairs to check. The requests are expanded to
    the expected metrics first and meet the measured ones on (batch, sensor, metric), a
    key that spreads evenly however many targets one baseline has. Metrics the target
    run lacks are skipped.
    """
    limits = thresholds.select("baseline_id", *KEY, "baseline_value", "warn_pct", "block_pct")
    expected = _expected(requests, limits)
    pairs = expected.join(metrics.select("batch_id", *KEY, "metric_value"), ["batch_id", *KEY])
    return _judged(pairs.where(F.col("metric_value").isNotNull())).select(
        "baseline_id", "batch_id", *KEY, "baseline_value", "actual_value",
        "absolute_diff", "relative_pct", "warn_pct", "block_pct", "status",
    )


def drift_check_by_name(thresholds: DataFrame, metrics: DataFrame, requests: DataFrame) -> DataFrame:
    """The same keyed by metric name alone: the alphabetically last sensor speaks for all."""
    per_name = thresholds.groupBy("baseline_id", "metric_name").agg(*[
        F.max_by(c, "sensor").alias(c) for c in ("baseline_value", "warn_pct", "block_pct")
    ])
    actual = (
        metrics.where(F.col("metric_value").isNotNull())
        .groupBy("batch_id", "metric_name")
        .agg(F.max_by("metric_value", "sensor").alias("metric_value"))
    )
    pairs = _expected(requests, per_name).join(actual, ["batch_id", "metric_name"])
    return _judged(pairs).select(
        "baseline_id", "batch_id", "metric_name", "baseline_value", "actual_value",
        "absolute_diff", "relative_pct", "status",
    )


def drift_verdict(checks: DataFrame, requests: DataFrame) -> DataFrame:
    """Counts per check, the worst status and what to do; nothing shared passes with 0."""
    counts = checks.groupBy("baseline_id", "batch_id").agg(
        F.count(F.lit(1)).alias("total_metrics"),
        F.count_if(F.col("status") == "pass").alias("pass_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"),
        F.count_if(F.col("status") == "block").alias("block_count"),
    )
    names = ["total_metrics", "pass_count", "warn_count", "block_count"]
    verdict = F.when(F.col("block_count") > 0, "block").when(F.col("warn_count") > 0, "warn").otherwise("pass")
    action = (
        F.when(F.col("check_status") == "block", "stop and investigate")
        .when(F.col("check_status") == "warn", "review before going on")
        .otherwise("go on")
    )
    return (
        requests.select("baseline_id", "batch_id")
        .join(counts, ["baseline_id", "batch_id"], "left")
        .fillna(0, names)
        .withColumn("check_status", verdict)
        .withColumn("recommended_action", action)
    )


def registration_decisions(
    requests: DataFrame, batches: DataFrame, runs: DataFrame, baselines: DataFrame
) -> DataFrame:
    """Which baseline requests (``name, batch_id, run_id``) may go ahead, else why not.

    A missing ``run_id`` means the newest run of the batch. Names of deleted baselines
    stay taken. Of several requests for one name the smallest ``request_id`` counts.
    """
    newest_run = runs.groupBy("batch_id").agg(F.max("run_id").alias("_newest"))
    wanted = (
        requests.join(batches.select("batch_id", F.lit(True).alias("_batch")), "batch_id", "left")
        .join(newest_run, "batch_id", "left")
        .withColumn("run_id", F.coalesce("run_id", "_newest"))
        .join(
            runs.select("run_id", F.col("batch_id").alias("_owner"), "run_status"), "run_id", "left"
        )
        .join(baselines.select("name", F.lit(True).alias("_taken")).distinct(), "name", "left")
    )
    reason = (
        F.when(F.col("_batch").isNull(), "batch_not_found")
        .when(F.col("run_id").isNull(), "batch_not_run")
        .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("batch_id")), "run_not_of_batch")
        .when(F.col("run_status") != "success", "run_not_successful")
        .when(F.col("_taken"), "name_exists")
    )
    judged = wanted.withColumn("reason", reason)
    first = judged.where("reason IS NULL").groupBy("name").agg(F.min("request_id").alias("_first"))
    late = F.col("reason").isNull() & (F.col("request_id") != F.col("_first"))
    return judged.join(first, "name", "left").select(
        "request_id", "name", "batch_id", "run_id",
        F.when(late, "name_exists").otherwise(F.col("reason")).alias("reason"),
    )


def last_checks(checks: DataFrame, keep: int = 1) -> DataFrame:
    """The newest ``keep`` checks of every baseline."""
    return newest(checks, "baseline_id", "id", keep)
