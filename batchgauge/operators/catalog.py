"""Runs and registry listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.operators.slicing import ROWS_PER_SLICE, with_positions


def newest(df: DataFrame, key: str, order: str = "id", rank: int = 1) -> DataFrame:
    """Newest rows of each group, up to ``rank`` of them (``newest_rank`` 1 is the newest).

    A bounded ``row_number`` filter is cut on the map side as well, so a group of any
    size sends at most ``rank`` rows per task.
    """
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("newest_rank", F.row_number().over(window)).where(
        F.col("newest_rank") <= rank
    )


def latest_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    """Newest run per batch, whatever its status unless one is asked for."""
    eligible = runs if status is None else runs.where(F.col("run_status") == status)
    return newest(eligible, "batch_id", "run_id").drop("newest_rank")


def number_runs(runs: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """1, 2, 3, ... inside each batch in order of the run id."""
    return with_positions(runs, ["batch_id"], "run_id", "run_id", "run_number", rows_per_slice)


def append_numbers(runs: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Numbers for runs to be added: go on after the highest number of the batch."""
    highest = runs.groupBy("batch_id").agg(F.max("run_number").alias("_highest"))
    numbered = number_runs(new_runs)
    return numbered.join(highest, "batch_id", "left").withColumn(
        "run_number", F.col("run_number") + F.coalesce("_highest", F.lit(0))
    ).drop("_highest")


def batch_status(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """locked, else by the newest run: processed, failed, or pending without a result."""
    latest = latest_run(runs).select("batch_id", "run_status")
    status = (
        F.when(F.col("locked"), "locked")
        .when(F.col("run_status") == "success", "processed")
        .when(F.col("run_status") == "failed", "failed")
        .otherwise("pending")
    )
    return batches.join(latest, "batch_id", "left").select("batch_id", status.alias("batch_status"))


def eligible_batches(batches: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Batches that may be processed or changed (not locked), or the requests for them."""
    free = batches.where(~F.col("locked"))
    if requests is None:
        return free
    return requests.join(free.select("batch_id"), "batch_id", "left_semi")


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; an option that is None does not filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def newest_first(df: DataFrame, limit: int, order: str = "id", **equal) -> DataFrame:
    """The newest matching rows (audit log, ticket list, check history)."""
    return filtered(df, **equal).orderBy(F.desc(order)).limit(limit)


def listing(df: DataFrame, columns: list[str], *order: Column) -> DataFrame:
    """A narrow ordered listing; unused columns are never read."""
    return df.select(*columns).orderBy(*order)
