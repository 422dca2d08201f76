"""De-duplication and missing-value strategies on long readings.

Readings: ``batch_id, row_number, ts, sensor, value``; a missing cell is a NULL value,
and every source row has one reading per sensor of its batch.

``rows_per_slice``, ``profile`` and ``largest`` are those of ``slicing.slice_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.slicing import ROWS_PER_SLICE, with_neighbours

SERIES = ["batch_id", "sensor"]


def dedup_readings(readings: DataFrame) -> DataFrame:
    """Keep the first row (smallest ``row_number``) of each timestamp of a series.

    Plain aggregates, so copies combine before the shuffle and a timestamp repeated any
    number of times never meets in one task.
    """
    return (
        readings.groupBy("batch_id", "sensor", "ts")
        .agg(F.min_by("value", "row_number").alias("value"), F.min("row_number").alias("row_number"))
        .select("batch_id", "row_number", "ts", "sensor", "value")
    )


def dedup_rows(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """The same on wide rows: one aggregate per sensor column."""
    return (
        rows.groupBy("batch_id", "ts")
        .agg(
            F.min("row_number").alias("row_number"),
            *[F.min_by(s, "row_number").alias(s) for s in sensors],
        )
        .select("batch_id", "row_number", "ts", *sensors)
    )


def _interpolated(limit: Column) -> Column:
    near = (F.col("pos") - F.col("prev_pos") <= limit) | (F.col("next_pos") - F.col("pos") <= limit)
    steps = (F.col("pos") - F.col("prev_pos")) / (F.col("next_pos") - F.col("prev_pos"))
    line = (
        F.when(F.col("prev_pos").isNull(), F.col("next_value"))
        .when(F.col("next_pos").isNull(), F.col("prev_value"))
        .otherwise(F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * steps)
    )
    return F.coalesce(F.col("value"), F.when(near, line))


def _neighbours(
    readings: DataFrame, rows_per_slice: int, profile: DataFrame | None, largest: int | None
) -> DataFrame:
    return with_neighbours(
        readings, SERIES, "ts", "row_number", "value", rows_per_slice, profile, largest
    )


def interpolate(
    readings: DataFrame,
    limit: int = 5,
    fill: float = 0.0,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Linear in row position; ``limit`` cells are filled from either side of a gap, the
    border value is copied outwards at the ends, whatever is left becomes ``fill``."""
    if limit < 1:
        raise ValueError("limit must be greater than 0")
    value = F.coalesce(_interpolated(F.lit(limit)), F.lit(float(fill)))
    return _neighbours(readings, rows_per_slice, profile, largest).select(
        "batch_id", "row_number", "ts", "sensor", value.alias("value")
    )


def fill_constant(readings: DataFrame, fill: float = 0.0) -> DataFrame:
    return readings.withColumn("value", F.coalesce(F.col("value"), F.lit(float(fill))))


def fill_forward_back(
    readings: DataFrame,
    fill: float = 0.0,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Last known value, before the first known one the next, else ``fill``."""
    value = F.coalesce("value", "prev_value", "next_value", F.lit(float(fill)))
    return _neighbours(readings, rows_per_slice, profile, largest).select(
        "batch_id", "row_number", "ts", "sensor", value.alias("value")
    )


def drop_incomplete(readings: DataFrame) -> DataFrame:
    """Drop every source row in which any sensor is missing."""
    gaps = readings.where(F.col("value").isNull()).select("batch_id", "row_number").distinct()
    return readings.join(gaps, ["batch_id", "row_number"], "left_anti").select(*readings.columns)


def flag_incomplete(readings: DataFrame, config: DataFrame) -> DataFrame:
    """Mark (``incomplete``) the rows with a missing sensor in batches that drop them.

    Whether a row is complete does not depend on later steps, so it is settled on the raw
    readings, before they are brought together by series; without a dropping batch there
    is nothing to join.
    """
    dropping = config.where("strategy = 'drop'").select("batch_id")
    if dropping.isEmpty():
        return readings.withColumn("incomplete", F.lit(False))
    gaps = (
        readings.where(F.col("value").isNull())
        .join(dropping, "batch_id", "left_semi")
        .select("batch_id", "row_number", F.lit(True).alias("incomplete"))
        .distinct()
    )
    return readings.join(gaps, ["batch_id", "row_number"], "left").fillna(False, ["incomplete"])


def clean_by_config(readings: DataFrame, config: DataFrame) -> DataFrame:
    """De-duplicate the batches whose configuration asks for it; a flag of
    ``flag_incomplete`` stays with its row."""
    wanted = config.select("batch_id", "remove_duplicates")
    # rows of the other batches keep apart by their own row number
    apart = F.when(~F.col("remove_duplicates"), F.col("row_number"))
    carried = [c for c in ("value", "incomplete") if c in readings.columns]
    return (
        readings.join(wanted, "batch_id")
        .groupBy("batch_id", "sensor", "ts", apart.alias("_apart"))
        .agg(
            F.min("row_number").alias("row_number"),
            *[F.min_by(c, "row_number").alias(c) for c in carried],
        )
        .select("batch_id", "row_number", "ts", "sensor", *carried)
    )


def impute_by_config(
    readings: DataFrame,
    config: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Each batch by its own strategy: interpolate, fill, ffill, drop; any other leaves
    missing values as they are. ``config`` is a flat configuration table."""
    if "incomplete" not in readings.columns:
        readings = flag_incomplete(readings, config)
    options = config.select("batch_id", "strategy", "numeric_fill_value", "max_interpolate_gap")
    rows = _neighbours(readings, rows_per_slice, profile, largest).join(options, "batch_id")
    strategy, fill = F.col("strategy"), F.col("numeric_fill_value")
    limit = F.when(F.col("max_interpolate_gap") >= 1, F.col("max_interpolate_gap")).otherwise(
        F.raise_error(F.lit("max_interpolate_gap must be greater than 0"))
    )
    value = (
        F.when(strategy == "interpolate", F.coalesce(_interpolated(limit), fill))
        .when(strategy == "fill", F.coalesce("value", fill))
        .when(strategy == "ffill", F.coalesce("value", "prev_value", "next_value", fill))
        .otherwise(F.col("value"))
    )
    return rows.where((strategy != "drop") | ~F.col("incomplete")).select(
        "batch_id", "row_number", "ts", "sensor", value.alias("value")
    )
