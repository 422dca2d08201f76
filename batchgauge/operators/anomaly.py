"""Outlier marking and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.slicing import stored_small

SERIES = ["batch_id", "sensor"]
READING = ["batch_id", "sensor", "row_number", "ts", "value"]


def _z() -> Column:
    return F.abs((F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))


def _fences(multiplier: Column) -> tuple[Column, Column]:
    spread = F.col("q3") - F.col("q1")
    return F.col("q1") - multiplier * spread, F.col("q3") + multiplier * spread


def _side(lower: Column, upper: Column) -> Column:
    # infinite quartiles give NaN fences, which Spark would hold larger than any value
    return F.when((F.col("value") < lower) & ~F.isnan(lower), "below_lower").when(
        (F.col("value") > upper) & ~F.isnan(upper), "above_upper")


def zscore_anomalies(
    readings: DataFrame, stats: DataFrame, threshold: float = 3.0, min_values: int = 5
) -> DataFrame:
    """Readings farther than ``threshold`` sample deviations from the mean (strict)."""
    eligible = stats.where((F.col("count") >= min_values) & (F.col("std") > 0) & ~F.isnan("std"))
    return (
        # one row per series: broadcast if measured small, so the readings stay where they are
        readings.join(stored_small(eligible.select(*SERIES, "mean", "std")), SERIES)
        .withColumn("score", _z())
        .where((F.col("score") > threshold) & ~F.isnan("score"))
        .select(*READING, "score")
    )


def iqr_anomalies(
    readings: DataFrame, stats: DataFrame, multiplier: float = 1.5, min_values: int = 5
) -> DataFrame:
    """Readings outside the quartile fences, with the side they fall out on."""
    eligible = stats.where(F.col("count") >= min_values)
    lower, upper = _fences(F.lit(float(multiplier)))
    return (
        readings.join(stored_small(eligible.select(*SERIES, "q1", "q3")), SERIES)
        .withColumns({"lower": lower, "upper": upper})
        .withColumn("side", _side(F.col("lower"), F.col("upper")))
        .where(F.col("side").isNotNull())
        .select(*READING, "lower", "upper", "side")
    )


def anomalies_by_config(readings: DataFrame, stats: DataFrame, config: DataFrame) -> DataFrame:
    """Each batch by its own method and thresholds; an unknown method marks nothing.

    The options are joined to the statistics (one row per series) first, so the readings
    take part in a single join.
    """
    options = config.select(
        "batch_id", "method", "zscore_threshold", "iqr_multiplier", "min_values"
    )
    lower, upper = _fences(F.col("iqr_multiplier"))
    limits = (
        stats.join(options, "batch_id")
        .where(F.col("count") >= F.col("min_values"))
        .where("(method = 'zscore' AND std > 0 AND NOT isnan(std)) OR method = 'iqr'")
        .select(
            *SERIES, "method", "mean", "std", "zscore_threshold",
            F.when(F.col("method") == "iqr", lower).alias("lower"),
            F.when(F.col("method") == "iqr", upper).alias("upper"),
        )
    )
    score = F.when(F.col("method") == "zscore", _z())
    side = F.when(F.col("method") == "iqr", _side(F.col("lower"), F.col("upper")))
    return (
        readings.where(F.col("value").isNotNull())
        .join(limits, SERIES)
        .withColumns({"score": score, "side": side})
        .where(((F.col("score") > F.col("zscore_threshold")) & ~F.isnan("score")) | F.col("side").isNotNull())
        .select(*READING, "method", "score", "lower", "upper", "side")
    )


def anomaly_label(score: Column, lower: Column, upper: Column, side: Column) -> Column:
    """Display text of an anomaly; never a key."""
    return F.when(score.isNotNull(), F.format_string("zscore (z=%.2f)", score)).otherwise(
        F.format_string("iqr (%s: [%.2f, %.2f])", side, lower, upper)
    )


def threshold_sweep(
    readings: DataFrame, stats: DataFrame, thresholds: list[float], min_values: int = 5
) -> DataFrame:
    """Anomalies per batch for several z-score thresholds, from one pass over the scores."""
    scored = zscore_anomalies(readings, stats, min(thresholds), min_values)
    counts = [F.count_if(F.col("score") > t).alias(str(i)) for i, t in enumerate(thresholds)]
    batches = stats.select("batch_id").distinct()
    wide = batches.join(scored.groupBy("batch_id").agg(*counts), "batch_id", "left").fillna(0)
    values = F.create_map(*[x for i, t in enumerate(thresholds) for x in (F.lit(str(i)), F.lit(t))])
    return wide.unpivot(
        ["batch_id"], [str(i) for i in range(len(thresholds))], "i", "anomalies"
    ).select("batch_id", values[F.col("i")].alias("threshold"), "anomalies")


def anomaly_counts(anomalies: DataFrame, batches: DataFrame) -> DataFrame:
    """Anomalies per batch and sensor and per batch in total (sensor NULL), zeros kept."""
    per_sensor = anomalies.groupBy("batch_id", "sensor").agg(F.count(F.lit(1)).alias("anomalies"))
    totals = (
        batches.select("batch_id")
        .join(per_sensor.groupBy("batch_id").agg(F.sum("anomalies").alias("anomalies")), "batch_id", "left")
        .select("batch_id", F.lit(None).cast("string").alias("sensor"),
                F.coalesce("anomalies", F.lit(0)).alias("anomalies"))
    )
    return per_sensor.unionByName(totals)


def anomaly_range(counts: DataFrame) -> DataFrame:
    """Smallest, largest and spread of the batch totals, and how many sensors are hit."""
    # one row per sensor first; the totals are the NULL sensor
    per_sensor = counts.groupBy("sensor").agg(
        F.min("anomalies").alias("lo"),
        F.max("anomalies").alias("hi"),
        F.count(F.lit(1)).alias("batches"),
    )
    total = F.col("sensor").isNull()
    spread = F.when(F.col("batches") >= 2, F.col("hi") - F.col("lo"))
    return per_sensor.agg(
        F.coalesce(F.max(F.when(total, F.col("lo"))), F.lit(0)).alias("min_total"),
        F.coalesce(F.max(F.when(total, F.col("hi"))), F.lit(0)).alias("max_total"),
        F.max(F.when(total, spread)).alias("abs_diff"),
        F.count_if(~total).alias("sensors"),
    )


def sensors_with_anomalies(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("sensor").isNotNull()).select("sensor").distinct()


def error_type_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("batch_id", "error_type").agg(F.count(F.lit(1)).alias("errors"))


def anomaly_kind_counts(anomalies: DataFrame) -> DataFrame:
    """Anomalies by method and side; the label text would give a bucket per anomaly."""
    return anomalies.groupBy("batch_id", "method", "side").agg(F.count(F.lit(1)).alias("anomalies"))
