"""Quartiles of very large series from mergeable sketches, an option beside the exact selection.

A KLL sketch per series is stored with the run it belongs to. Sketches of several runs, days or sites
merge without their readings. A quantile taken from a sketch is a value of the series whose rank is off by
no more than ``rank_error`` of the number of values, in 99 of 100 cases; sketches of series with fewer values
than ``k`` are exact. Two evaluations may choose other values within that bound: what has to repeat
exactly takes ``metrics.series_stats``, which is the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = ["batch_id", "sensor"]
K = 800
"""Size parameter of a sketch: some ten kilobytes a series, whatever its length."""


def rank_error(k: int = K) -> float:
    """Bound of the normalised rank error of one quantile at 99 % confidence, as the KLL paper's
    implementation states it."""
    return 2.296 / k**0.9021


def series_sketches(readings: DataFrame, keys: list[str] | None = None, k: int = K) -> DataFrame:
    """One sketch per series of its known values (NaN left out): ``keys, n, least, most, sketch``."""
    known = readings.where("value IS NOT NULL AND NOT isnan(value)")
    return known.groupBy(*(keys or SERIES)).agg(
        F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same ``keys`` joined into one, such as those of several runs."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


def sketch_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Replace the sketch by quantiles, ``name -> share``."""
    return sketches.withColumns({name: _quantile(share) for name, share in shares.items()}).drop("sketch")


def sketch_stats(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Quartiles, extremes and range as ``metrics.series_stats`` names them."""
    found = sketch_quantiles(sketches, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return found.select(
        *(keys or SERIES), F.col("n").alias("count"), F.col("least").alias("min"), "q1", "median", "q3", F.col("most").alias("max"),
        (F.col("most") - F.col("least")).alias("range"))


def measured_error(readings: DataFrame, estimates: DataFrame, names: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """How far the ranks of estimated quantiles are off, as a share of the values: ``keys, n, <name>_error``.

    The rank of a value that occurs several times is the nearest one of its occurrences.
    """
    keys = keys or SERIES
    known = readings.where("value IS NOT NULL AND NOT isnan(value)").select(*keys, "value")
    joined = known.join(estimates.select(*keys, *names), keys)
    counts = [c for name in names for c in (
        F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto"))]
    found = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    return found.select(*keys, "n", *[
        F.greatest(F.lit(0.0), F.col(f"{name}_below") / F.col("n") - share, share - F.col(f"{name}_upto") / F.col("n")).alias(f"{name}_error")
        for name, share in names.items()])
