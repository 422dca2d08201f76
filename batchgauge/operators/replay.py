"""Replay comparison, source samples and result-set summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.functions.json_text import json_sha256
from batchgauge.operators.slicing import ROWS_PER_SLICE, left_join_known, stored_small, with_positions
from batchgauge.sources.integrity import FORMAT_VERSION

KEY = ["batch_id", "sensor", "metric_name"]


def replay_comparison(stored: DataFrame, replayed: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Every metric of either side with its difference and whether it is tolerable."""
    old, new = F.col("original_value"), F.col("new_value")
    diff = F.when(old == new, 0.0).otherwise(F.abs(new - old))  # also of infinities and NaN
    rel = F.when(old != 0, diff / F.nullif(F.abs(old), F.lit(0.0)) * 100).otherwise(
        F.when(diff == 0, 0.0).when(diff > 0, F.lit(float("inf")))
    )
    return (
        stored.select(*KEY, F.col("metric_value").alias("original_value"))
        .join(replayed.select(*KEY, F.col("metric_value").alias("new_value")), KEY, "full_outer")
        .withColumns({"abs_diff": diff, "rel_diff_pct": rel})
        .withColumn("within_tolerance", F.coalesce(F.col("rel_diff_pct") <= tolerance_pct, F.lit(False)))
        .withColumn("one_sided", old.isNull() | new.isNull())
    )


def _differs() -> Column:
    return F.col("one_sided") | ((F.col("abs_diff") > 0) & ~F.isnan("abs_diff"))


def replay_differences(comparison: DataFrame) -> DataFrame:
    """Only what differs: a value moved, or the metric exists on one side only."""
    return comparison.where(_differs())


def first_differences(differences: DataFrame, limit: int = 20) -> DataFrame:
    return differences.orderBy(*KEY).limit(limit)


def replay_verdict(comparison: DataFrame) -> DataFrame:
    """Counts per replayed batch; acceptable when every difference is tolerable."""
    differs = _differs()
    return comparison.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_metrics_compared"),
        F.count_if(differs).alias("metrics_with_diff"),
        F.count_if(differs & ~F.col("within_tolerance")).alias("metrics_out_of_tolerance"),
        F.bool_and(~differs | F.col("within_tolerance")).alias("acceptable"),
    )


def even_sample(
    rows: DataFrame, sample_rows: int = 10, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Up to ``sample_rows`` rows per batch, evenly spaced in time order.

    The i-th wanted index is ``floor(i * ((n - 1) / (k - 1)))`` in double arithmetic, the
    last one exactly ``n - 1``. Testing a row against it needs only the position and the
    row count; positions come from ``with_positions``, safe for batches of any size.
    """
    placed = with_positions(rows, ["batch_id"], "ts", "row_number", "pos", rows_per_slice)
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(sample_rows), F.col("n"))
    wanted = F.transform(
        F.sequence(F.lit(0).cast("bigint"), k - 1),
        lambda i: F.when(i == 0, F.lit(0).cast("bigint"))
        .when(i == k - 1, F.col("n") - 1)
        .otherwise(F.floor(i * ((F.col("n") - 1) / F.greatest(k - 1, F.lit(1))))),
    )
    # at most ``sample_rows`` rows per batch
    chosen = stored_small(sizes.select("batch_id", F.explode(F.array_distinct(wanted)).alias("idx")))
    return placed.withColumn("idx", F.col("pos") - 1).drop("pos").join(chosen, ["batch_id", "idx"])


def capped(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each run in the order they were stored."""
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= cap).drop("_nth")


def kind_counts(rows: DataFrame, kind: Column, name: str) -> DataFrame:
    """Per run the number of rows of each kind, as a list of ``kind, n`` in order of the kind."""
    counted = rows.groupBy("run_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias(name))


def snapshot_manifest(
    runs: DataFrame, batches: DataFrame, metrics: DataFrame, anomalies: DataFrame, errors: DataFrame
) -> DataFrame:
    """One row per stored run: where it came from, its configuration with checksum, totals and
    counts by kind. ``runs`` carry the ``config_json`` they ran with.

    The kind of an anomaly is its method: labels hold the values and would be a kind each.
    """
    method = F.substring_index("anomaly_type", " (", 1)
    counted = metrics.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_metrics"))
    # equal configurations are digested once; runs share them
    texts = runs.select("config_json").where("config_json IS NOT NULL").distinct()
    digests = stored_small(texts.withColumn("config_sha256", json_sha256(F.col("config_json"))))
    own = ["run_id", "batch_id", "run_number", "config_version", "rows_processed", "rows_errors", "config_json"]
    kinds = {"anomaly_type_counts": "total_anomalies", "error_type_counts": "total_errors"}
    return (
        runs.select(*own)
        .join(batches.select("batch_id", "batch_name", "source_file"), "batch_id", "left")
        .join(counted, "run_id", "left")
        .join(kind_counts(anomalies, method, "anomaly_type_counts"), "run_id", "left")
        .join(kind_counts(errors, F.col("error_type"), "error_type_counts"), "run_id", "left")
        .transform(left_join_known, digests, "config_json", "run_id")
        .withColumn("total_metrics", F.coalesce("total_metrics", F.lit(0)))
        .withColumns({c: F.coalesce(c, F.array().cast("array<struct<kind:string,n:bigint>>")) for c in kinds})
        .withColumns({
            "format_version": F.lit(FORMAT_VERSION),
            # every row has one kind, so the totals are the sums of the counts
            **{total: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, k: n + k["n"]) for c, total in kinds.items()},
        })
        .select(*own, "batch_name", "source_file", "total_metrics", *kinds.values(), *kinds, "format_version", "config_sha256")
    )


def manifest_summary(
    runs: DataFrame, metrics: DataFrame, anomalies: DataFrame, errors: DataFrame
) -> DataFrame:
    """Totals of a stored run; lists are capped when written, totals never are."""
    totals = runs.select("run_id", "batch_id", "run_number", "config_version")
    for rows, name in (
        (metrics, "total_metrics"), (anomalies, "total_anomalies"), (errors, "total_errors"),
    ):
        counted = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
        totals = totals.join(counted, "run_id", "left").fillna(0, [name])
    return totals


