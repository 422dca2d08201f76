"""Exact quantiles (linear interpolation between order statistics) for groups of any size.

``percentile`` is exact but keeps every distinct value of a group in one task's memory,
so it is used for groups up to ``exact_rows``. The order statistics of larger groups are
found by selection: count values per histogram bucket (pre-aggregated on the map side),
keep the bucket that holds the wanted rank, and repeat inside it until it is small.
Only counts move between passes; no pass sorts or collects a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.operators.slicing import largest_group, small_side
from batchgauge.session import materialise

EXACT_ROWS = 250_000
"""Largest group handed to ``percentile``: bounds the value map of a task to some 100 MB."""

MAX_BUCKETS = 4096
"""Histogram buckets per bracket and pass; more passes follow where that is too coarse."""


def percentiles(value: str, probs: list[float]) -> Column:
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    exact_rows: int = EXACT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """One row per group: ``keys`` and ``q`` = array of quantiles in the order of ``probs``.

    ``largest`` is (an upper bound of) the size of the largest group if it is known. The
    rows are read several times when a group is larger than ``exact_rows``: store them
    first if they are costly to compute.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
    if largest is None:
        largest = largest_group(rows, keys)
    if largest <= exact_rows:
        return rows.groupBy(*keys).agg(percentiles(value, probs).alias("q"))

    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    large = materialise(sizes.where(F.col("_n") > exact_rows))
    n_large = large.count()
    small = rows.join(small_side(large.select(*keys), n_large), keys, "left_anti")
    return (
        small.groupBy(*keys)
        .agg(percentiles(value, probs).alias("q"))
        .unionByName(_by_selection(rows, large, n_large, keys, value, probs, exact_rows))
    )


def _by_selection(
    rows: DataFrame,
    sizes: DataFrame,
    groups: int,
    keys: list[str],
    value: str,
    probs: list[float],
    exact_rows: int,
) -> DataFrame:
    bounds = ["_lo", "_hi"]
    spot = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at"))
        for i, p in enumerate(probs)
    ]))
    targets = materialise(
        sizes.select(*keys, *bounds, F.lit(0).cast("bigint").alias("_below"),
                     F.col("_n").alias("_inside"), spot.alias("_spot"))
        .select("*", F.explode(F.array_distinct(F.array(
            F.floor("_spot._at"), F.ceil("_spot._at")))).alias("_rank"))
    )
    most = groups * 2 * len(probs)
    done: list[DataFrame] = []
    while True:
        settled = (F.col("_inside") <= exact_rows) | (F.col("_lo") == F.col("_hi"))
        done.append(targets.where(settled))
        targets = targets.where(~settled)
        if targets.isEmpty():
            break
        targets = materialise(_narrow(rows, targets, most, keys, value, exact_rows))

    found = reduce(DataFrame.unionByName, done)
    constant = found.where(F.col("_lo") == F.col("_hi")).withColumn("_v", F.col("_lo"))
    ranged = found.where(F.col("_lo") < F.col("_hi"))
    spans = ranged.select(*keys, *bounds).distinct()
    nth = Window.partitionBy(*keys, *bounds).orderBy(value)
    ordered = (
        rows.join(small_side(spans, most), keys)
        .where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        .withColumn("_nth", F.row_number().over(nth) - 1)
    )
    picked = (
        ordered.join(small_side(ranged, most), keys + bounds)
        .where(F.col("_rank") - F.col("_below") == F.col("_nth"))
        .withColumn("_v", F.col(value))
    )
    columns = [*keys, "_spot", "_rank", "_v"]
    ranks = constant.select(*columns).unionByName(picked.select(*columns))
    at = F.col("_spot._at")
    weight = F.when(F.floor(at) == F.ceil(at), 1.0).otherwise(1.0 - F.abs(at - F.col("_rank")))
    return (
        ranks.groupBy(*keys, F.col("_spot._i").alias("_i"))
        .agg(F.sum(weight * F.col("_v")).alias("_v"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("q"))
        .withColumn("q", F.col("q._v"))
    )


def _narrow(
    rows: DataFrame, targets: DataFrame, most: int, keys: list[str], value: str, exact_rows: int
) -> DataFrame:
    """Replace each bracket by the histogram bucket that holds its rank."""
    span = [*keys, "_lo", "_hi"]
    spans = targets.select(
        *span,
        F.least(F.ceil(F.col("_inside") / exact_rows) * 4, F.lit(MAX_BUCKETS)).alias("_k"),
    ).distinct()
    width = F.col("_hi") - F.col("_lo")
    share = F.when(
        width < float("inf"), F.floor((F.col(value) - F.col("_lo")) / width * F.col("_k"))
    )
    # an infinite border: keep both ends apart, everything finite in the middle
    ends = F.when(F.col(value) == F.col("_lo"), 0).when(
        F.col(value) == F.col("_hi"), F.col("_k") - 1
    ).otherwise(F.col("_k") / 2)
    bucket = F.least(F.coalesce(share, ends).cast("bigint"), F.col("_k") - 1)
    earlier = Window.partitionBy(*span).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        rows.join(small_side(spans, most), keys)
        .where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        .groupBy(*span, bucket.alias("_bucket"))
        .agg(
            F.count(F.lit(1)).alias("_c"), F.min(value).alias("_blo"), F.max(value).alias("_bhi")
        )
        .withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    )
    offset = F.col("_rank") - F.col("_below")
    return (
        histogram.join(small_side(targets, most), span)
        .where((offset >= F.col("_before")) & (offset < F.col("_before") + F.col("_c")))
        .select(
            *keys,
            F.col("_blo").alias("_lo"),
            F.col("_bhi").alias("_hi"),
            (F.col("_below") + F.col("_before")).alias("_below"),
            F.col("_c").alias("_inside"),
            "_spot",
            "_rank",
        )
    )
