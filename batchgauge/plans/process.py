"""A complete run over all batches of a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators import anomaly, impute, metrics
from batchgauge.operators.quantiles import EXACT_ROWS
from batchgauge.operators.slicing import ROWS_PER_SLICE, stored_small
from batchgauge.session import materialise


@dataclass(frozen=True)
class RunResult:
    imputed: DataFrame
    stats: DataFrame
    metrics: DataFrame
    anomalies: DataFrame
    counters: DataFrame
    runs: DataFrame


def by_series(readings: DataFrame) -> DataFrame:
    """Bring each series into one task right away, for series that fit.

    De-duplication, the window over the series and the statistics then all work inside
    that partitioning: one shuffle for the whole run.
    """
    return readings.repartition(*impute.SERIES)


@dataclass(frozen=True)
class Route:
    """Series that take the same plan: ``largest`` bounds their size, ``cut`` says whether they are cut."""

    series: DataFrame | None
    largest: int
    cut: bool

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows of these series. The list of large series decides; it is stored and measured."""
        if self.series is None:
            return rows
        return rows.join(self.series, impute.SERIES, "left_semi" if self.cut else "left_anti")


def routes(readings: DataFrame, limit: int) -> list[Route]:
    """Series by their measured size: ordinary ones of ``limit`` rows at most, and larger ones, which
    alone are cut. One scan of the key columns, combined on the map side."""
    sizes = readings.groupBy(*impute.SERIES).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = materialise(sizes)
    largest = large.agg(F.max("n")).first()[0]
    if largest is None:
        return [Route(None, limit, False)]
    series = stored_small(large.drop("n"))
    return [Route(series, limit, False), Route(series, largest, True)]


def process(
    readings: DataFrame,
    config: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    exact_rows: int = EXACT_ROWS,
    errors: DataFrame | None = None,
) -> RunResult:
    """Readings and a flat configuration table to metrics and anomalies.

    Sizes are measured once, on the scanned readings: a superset of the de-duplicated rows that
    costs a scan of the key columns. Ordinary series are brought into one task each and take one
    shuffle for the whole run, however large other series are; those are cut. The imputed rows feed
    every output, so they are written to the shared folder once; the statistics (one row per series)
    too, and they reach the readings by a broadcast if they are small.

    ``errors`` are the row-level errors of the readings, for the counters and the run records.
    """
    config = stored_small(config)
    flagged = impute.flag_incomplete(readings, config)
    imputed, stats = [], []
    for route in routes(readings, min(rows_per_slice, exact_rows)):
        own = route.of(flagged)
        cleaned = impute.clean_by_config(own if route.cut else by_series(own), config)
        profile = route.of(readings) if route.cut else None
        rows = materialise(impute.impute_by_config(cleaned, config, rows_per_slice, profile, route.largest))
        imputed.append(rows)
        stats.append(metrics.series_stats(rows, exact_rows=exact_rows, largest=route.largest, stored=True))
    imputed, stats = (reduce(DataFrame.unionByName, parts) for parts in (imputed, stats))
    stats = stored_small(stats)
    if errors is None:
        errors = readings.select("batch_id", "row_number").limit(0)
    counters = metrics.run_counters(imputed, errors)
    return RunResult(
        imputed=imputed,
        stats=stats,
        metrics=metrics.metrics_by_config(stats, config),
        anomalies=anomaly.anomalies_by_config(imputed, stats, config),
        counters=counters,
        runs=counters.select(
            "batch_id", F.lit("success").alias("run_status"), "rows_processed", F.col("error_records").alias("rows_errors")),
    )
