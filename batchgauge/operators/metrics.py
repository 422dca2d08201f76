"""Per-sensor statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.functions.settings import FLAGGED_METRICS
from batchgauge.operators.quantiles import EXACT_ROWS, exact_quantiles, percentiles
from batchgauge.operators.slicing import largest_group
from batchgauge.session import materialise

SERIES = ["batch_id", "sensor"]
QUARTILES = [0.25, 0.5, 0.75]


def _moments() -> list[Column]:
    return [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]


def series_moments(readings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, max per series with any known value: all a z-score needs."""
    return readings.groupBy(*(keys or SERIES)).agg(*_moments()).where(F.col("count") > 0)


def series_stats(
    readings: DataFrame,
    keys: list[str] | None = None,
    exact_rows: int = EXACT_ROWS,
    largest: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """The moments and q1, median, q3, range, null_count per series with any known value.

    One aggregate serves the metrics and both anomaly methods. Series too large for
    ``percentile`` get their quartiles by selection, which reads the rows several times:
    they are written to the shared folder first unless they are ``stored`` already, that
    is cheap to read. ``largest`` is the size of the largest series if it is known.
    """
    keys = keys or SERIES
    if largest is None:
        largest = largest_group(readings, keys)
    columns = [*_moments(), F.count_if(F.col("value").isNull()).alias("null_count")]
    if largest <= exact_rows:
        # stored rows first go to the task of their series: merging the value maps of
        # partial percentiles costs more than moving the values
        rows = readings.repartition(*keys) if stored else readings
        stats = rows.groupBy(*keys).agg(*columns, percentiles("value", QUARTILES).alias("q"))
    else:
        rows = readings.select(*keys, "value")
        rows = rows if stored else materialise(rows)
        q = exact_quantiles(rows, keys, "value", QUARTILES, exact_rows, largest)
        stats = rows.groupBy(*keys).agg(*columns).join(q, keys)
    return stats.where(F.col("count") > 0).select(
        *keys,
        "count",
        "null_count",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "max",
        (F.col("max") - F.col("min")).alias("range"),
    )


METRIC_NAMES = [*FLAGGED_METRICS, "count"]


def metric_rows(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long form: one row per series and metric, count included."""
    keys = keys or SERIES
    wide = stats.select(*keys, *[F.col(n).cast("double").alias(n) for n in METRIC_NAMES])
    return wide.unpivot(keys, METRIC_NAMES, "metric_name", "metric_value")


def metric_keys(imputed: DataFrame) -> DataFrame:
    """Sensors and metrics that ``metric_rows`` gives for the statistics of imputed readings: all metrics of every
    sensor with a known value. That needs no statistics, so no series comes together and a task holds sensors only.
    """
    known = imputed.where(F.col("value").isNotNull()).select("sensor").distinct()
    return known.select("sensor", F.explode(F.array(*map(F.lit, METRIC_NAMES))).alias("metric_name"))


def metrics_by_config(stats: DataFrame, config: DataFrame) -> DataFrame:
    """Long metrics of the kinds each batch has switched on; count is always there."""
    flags = config.select("batch_id", *[f"compute_{m}" for m in FLAGGED_METRICS])
    wanted = reduce(
        lambda a, m: a | ((F.col("metric_name") == m) & F.col(f"compute_{m}")),
        FLAGGED_METRICS,
        F.col("metric_name") == "count",
    )
    return (
        metric_rows(stats)
        .join(flags, "batch_id")
        .where(wanted)
        .select("batch_id", "sensor", "metric_name", "metric_value")
    )


def source_column_stats(readings: DataFrame) -> DataFrame:
    """Statistics of the raw values, with the number of missing cells per sensor."""
    return series_stats(readings, stored=True).select(
        "batch_id", "sensor", "count", "null_count", "mean", "std", "min", "max", "median"
    )


def source_summary(readings: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows, error records, sensor columns (their number and their names) and time range of each batch."""
    # two levels keep the per-batch distinct count off the raw rows
    per_sensor = readings.groupBy("batch_id", "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )
    per_batch = per_sensor.groupBy("batch_id").agg(
        F.max("n").alias("total_rows"),
        F.sum("n").alias("total_cells"),
        F.count(F.lit(1)).alias("sensor_columns"),
        F.array_sort(F.collect_list("sensor")).alias("columns"),
        F.min("t0").alias("time_start"),
        F.max("t1").alias("time_end"),
    )
    broken = errors.groupBy("batch_id").agg(F.count(F.lit(1)).alias("error_records"))
    return per_batch.join(broken, "batch_id", "left").fillna(0, ["error_records"])


def run_counters(readings: DataFrame, errors: DataFrame) -> DataFrame:
    """Processed rows, error records and rows with an error, per batch.

    ``readings`` are those that were processed: after cleaning and imputation.
    """
    # every row has one reading per sensor, so any sensor's count is the row count
    per_sensor = readings.groupBy("batch_id", "sensor").agg(F.count(F.lit(1)).alias("n"))
    processed = per_sensor.groupBy("batch_id").agg(F.max("n").alias("rows_processed"))
    per_row = errors.groupBy("batch_id", "row_number").agg(F.count(F.lit(1)).alias("n"))
    broken = per_row.groupBy("batch_id").agg(
        F.sum("n").alias("error_records"), F.count(F.lit(1)).alias("error_rows")
    )
    return processed.join(broken, "batch_id", "full_outer").fillna(0)
