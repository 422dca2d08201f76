"""Imputation, positions, quantiles, metrics and anomalies, against pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from batchgauge.functions.settings import with_option_defaults
from batchgauge.operators import anomaly, impute, metrics, quantiles, replay, slicing
from batchgauge.plans.process import process
from batchgauge.sources import csv_files
from batchgauge.operators import validate
from helpers import READING_SCHEMA, SAMPLE, lines_frame, minute, rows_of, series_frame


def random_series(seed, count=40):
    rng = random.Random(seed)
    series = {}
    for i in range(count):
        keep = rng.choice([0.05, 0.2, 0.5, 0.9])
        series[(f"b{i % 4}", f"s{i:02d}")] = [
            float(rng.randint(-50, 50)) if rng.random() < keep else None for _ in range(rng.randint(1, 60))
        ]
    return series


def values_of(df):
    found: dict = {}
    for r in df.orderBy("batch_id", "sensor", "ts", "row_number").collect():
        found.setdefault((r.batch_id, r.sensor), []).append(r.value)
    return found


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(list(values), abs=1e-9), key


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 7])
@pytest.mark.parametrize("limit", [1, 3, 8])
def test_interpolation_equals_pandas(spark, limit, rows_per_slice):
    series = random_series(limit)
    expected = {
        k: pd.Series(v, dtype=float).interpolate(method="linear", limit=limit, limit_direction="both").fillna(-1.0)
        for k, v in series.items()
    }
    filled = impute.interpolate(series_frame(spark, series), limit, -1.0, rows_per_slice)
    assert_same(values_of(filled), expected)


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 7])
def test_forward_back_fill_equals_pandas(spark, rows_per_slice):
    series = random_series(99)
    expected = {k: pd.Series(v, dtype=float).ffill().bfill().fillna(5.0) for k, v in series.items()}
    assert_same(values_of(impute.fill_forward_back(series_frame(spark, series), 5.0, rows_per_slice)), expected)


def test_long_gap_keeps_a_hole(spark):
    n = None
    filled = impute.interpolate(series_frame(spark, {("b", "s"): [n, n, n, 1.0, n, n, n, n, n, n, 8.0, n, n, n]}), 2, -9.0)
    assert values_of(filled)[("b", "s")] == [-9, 1, 1, 1, 2, 3, -9, -9, 6, 7, 8, 8, 8, -9]
    with pytest.raises(ValueError):
        impute.interpolate(filled, 0)


def test_drop_takes_the_whole_row(spark):
    readings = series_frame(spark, {("b", "x"): [1.0, None, 3.0], ("b", "y"): [1.0, 2.0, None], ("c", "x"): [None, 1.0]})
    assert rows_of(impute.drop_incomplete(readings), "batch_id", "row_number", "sensor") == [
        ("b", 2, "x"), ("b", 2, "y"), ("c", 3, "x")]


def test_dedup_keeps_the_first_line(spark):
    rows = [("b", 4, minute(1), "s", 4.0), ("b", 3, minute(1), "s", None), ("b", 2, minute(0), "s", 2.0),
            ("b", 6, None, "s", 6.0), ("b", 5, None, "s", 5.0)]
    readings = spark.createDataFrame(rows, READING_SCHEMA)
    assert rows_of(impute.dedup_readings(readings), "row_number", "value") == [(2, 2.0), (3, None), (5, 5.0)]
    wide = spark.createDataFrame([("b", 3, minute(0), 3.0, 1.0), ("b", 2, minute(0), None, 2.0)],
        "batch_id STRING, row_number BIGINT, ts TIMESTAMP_NTZ, x DOUBLE, y DOUBLE")
    assert rows_of(impute.dedup_rows(wide, ["x", "y"]), "row_number", "x", "y") == [(2, None, 2.0)]


def skewed(spark):
    """One group holds most rows, many of them in a burst, at one time, or without a time."""
    rng = random.Random(5)
    rows = [("hot", i, minute(rng.choice([0, 0, 1, 2, 50_000, rng.randint(0, 60)])) if i % 9 else None, "s",
             rng.choice([None, 1.0, float(i)])) for i in range(3000)]
    rows += [(f"g{i % 50}", i, minute(i), "s", float(i)) for i in range(200)]
    return spark.createDataFrame(rows, READING_SCHEMA).repartition(5)


def test_slices_change_nothing(spark):
    rows = skewed(spark)
    plain = slicing.with_neighbours(rows, ["batch_id"], "ts", "row_number", "value")
    cut = slicing.with_neighbours(rows, ["batch_id"], "ts", "row_number", "value", rows_per_slice=40)
    assert rows_of(plain, *plain.columns) == rows_of(cut, *plain.columns)
    plain = slicing.with_positions(rows, ["batch_id"], "ts", "row_number")
    cut = slicing.with_positions(rows, ["batch_id"], "ts", "row_number", rows_per_slice=40)
    assert rows_of(plain, "batch_id", "row_number", "pos") == rows_of(cut, "batch_id", "row_number", "pos")


def test_slices_stay_small(spark):
    sliced = slicing.slice_groups(skewed(spark), ["batch_id"], "ts", "row_number", 40)
    largest = sliced.df.where("_cut").groupBy("batch_id", *sliced.slices).count().agg(F.max("count")).first()[0]
    assert largest <= 80
    assert sliced.df.where("NOT _cut").select("batch_id").distinct().count() == 50
    assert slicing.slice_groups(skewed(spark), ["batch_id"], "ts", "row_number", 5000) is None


@pytest.mark.parametrize("exact_rows", [1_000_000, 20])
def test_quantiles_are_exact(spark, exact_rows):
    rng = np.random.default_rng(3)
    data = {
        "normal": rng.normal(size=900), "heavy": rng.pareto(0.7, size=701), "two": np.repeat([1.0, 2.0], [400, 401]),
        "const": np.full(500, 3.5), "small": rng.normal(size=7), "one": np.array([4.0]),
        "wide": np.concatenate([[-1e300, 1e300], rng.normal(size=300)]),
        "infinite": np.concatenate([[-math.inf, math.inf], rng.normal(size=300)]),
    }
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    rows = spark.createDataFrame([(k, float(v)) for k, values in data.items() for v in values], "k STRING, value DOUBLE")
    found = {r.k: r.q for r in quantiles.exact_quantiles(rows, ["k"], "value", probs, exact_rows).collect()}
    assert found.keys() == data.keys()
    for key, values in data.items():
        # the ends of a series with infinite values are not defined in pandas
        inner = slice(1, -1) if key == "infinite" else slice(None)
        expected = [float(x) for x in pd.Series(values).quantile(probs)]
        assert found[key][inner] == pytest.approx(expected[inner], rel=1e-12), key


def sample_readings(spark):
    return validate.readings_of(csv_files.scan(lines_frame(spark, {"f": SAMPLE})))


GOLDEN = {
    "flow": (6.155882, 6.41497, 4.0, 31.0, 4.6, 27.0, 17.0),
    "level": (225.764706, 9.444108, 210.0, 240.0, 226.0, 30.0, 17.0),
    "power": (1.348824, 0.054415, 1.27, 1.45, 1.34, 0.18, 17.0),
}


def default_config(spark, **options):
    base = spark.createDataFrame([("f",)], "batch_id STRING").withColumns({k: F.lit(v) for k, v in options.items()})
    return with_option_defaults(base)


@pytest.mark.parametrize("limits", [(2_000_000, 250_000), (4, 4)])
def test_sample_run(spark, limits):
    result = process(sample_readings(spark), default_config(spark), *limits)
    found = {(r.sensor, r.metric_name): r.metric_value for r in result.metrics.collect()}
    assert len(found) == 21
    for sensor, values in GOLDEN.items():
        for name, value in zip(["mean", "std", "min", "max", "median", "range", "count"], values):
            assert found[sensor, name] == pytest.approx(value, abs=1e-6)
    cells = {(r.row_number, r.sensor): r.value for r in result.imputed.collect()}
    assert cells[5, "level"] == pytest.approx(217.0)
    assert cells[7, "flow"] == pytest.approx(5.05)
    assert cells[9, "power"] == pytest.approx(1.31)
    marked = result.anomalies.collect()
    assert [(r.row_number, r.sensor, round(r.score, 4)) for r in marked] == [(13, "flow", 3.8728)]
    label = result.anomalies.select(anomaly.anomaly_label(*[F.col(c) for c in ("score", "lower", "upper", "side")]).alias("l"))
    assert label.first().l == "zscore (z=3.87)"


def test_sample_source_statistics(spark):
    found = {r.sensor: r for r in metrics.source_column_stats(sample_readings(spark)).collect()}
    for sensor, mean, std in (("flow", 6.225, 6.618812), ("level", 226.3125, 9.470788), ("power", 1.35125, 0.055242)):
        row = found[sensor]
        assert (row["count"], row.null_count) == (16, 1)
        assert (row["mean"], row["std"]) == (pytest.approx(mean, abs=1e-6), pytest.approx(std, abs=1e-6))


@pytest.mark.parametrize("threshold, others", [(3.0, []), (1.5, [("level", 2), ("level", 19), ("power", 12)])])
def test_sample_zscore(spark, threshold, others):
    filled = impute.interpolate(sample_readings(spark))
    found = anomaly.zscore_anomalies(filled, metrics.series_moments(filled), threshold)
    assert {(r.sensor, r.row_number) for r in found.collect()} == {("flow", 13), *others}


def test_sample_iqr(spark):
    filled = impute.interpolate(sample_readings(spark))
    stats = metrics.series_stats(filled)
    quartiles = {r.sensor: (round(r.q1, 4), round(r.q3, 4)) for r in stats.collect()}
    assert quartiles == {"flow": (4.3, 5.0), "level": (219.0, 233.0), "power": (1.31, 1.39)}
    assert rows_of(anomaly.iqr_anomalies(filled, stats), "sensor", "row_number", "side") == [("flow", 13, "above_upper")]


def test_edges_of_anomalies(spark):
    series = {("b", "flat"): [2.0] * 10, ("b", "few"): [1.0, 1.0, 1.0, 99.0], ("b", "none"): [None] * 6, ("b", "single"): [7.0]}
    readings = series_frame(spark, series)
    stats = metrics.series_stats(readings)
    assert rows_of(stats, "sensor", "std") == [("few", 49.0), ("flat", 0.0), ("single", 0.0)]
    assert anomaly.zscore_anomalies(readings, stats, 0.5).count() == 0
    assert anomaly.iqr_anomalies(readings, stats).count() == 0
    assert anomaly.zscore_anomalies(readings, stats, 1.0, min_values=4).count() == 1


def test_run_by_configuration(spark):
    values = [1.0, None, 3.0, 3.0, 100.0, 2.0, 2.0, 1.0]
    readings = series_frame(spark, {(b, "s"): values for b in ("fill", "ffill", "drop", "odd")})
    config = with_option_defaults(
        spark.createDataFrame([("fill", "fill", 9.0, "iqr", False), ("ffill", "ffill", 9.0, "zscore", True),
                               ("drop", "drop", 9.0, "other", True), ("odd", "odd", 9.0, "iqr", True)],
            "batch_id STRING, strategy STRING, numeric_fill_value DOUBLE, method STRING, compute_mean BOOLEAN")
        .withColumn("zscore_threshold", F.lit(2.0)))
    result = process(readings, config)
    second = {r.batch_id: r.value for r in result.imputed.where("row_number = 3").collect()}
    assert second == {"fill": 9.0, "ffill": 1.0, "odd": None}
    kinds = {r.batch_id: r.n for r in result.metrics.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"fill": 6, "ffill": 7, "drop": 7, "odd": 7}
    assert rows_of(result.anomalies, "batch_id", "method", "row_number") == [
        ("ffill", "zscore", 6), ("fill", "iqr", 3), ("fill", "iqr", 6), ("odd", "iqr", 6)]


def test_duplicates_kept_on_request(spark):
    rows = [("keep", 2, minute(0), "s", 1.0), ("keep", 3, minute(0), "s", 2.0), ("once", 2, minute(0), "s", 1.0), ("once", 3, minute(0), "s", 2.0)]
    config = with_option_defaults(spark.createDataFrame([("keep", False), ("once", True)], "batch_id STRING, remove_duplicates BOOLEAN"))
    cleaned = impute.clean_by_config(spark.createDataFrame(rows, READING_SCHEMA), config)
    assert rows_of(cleaned, "batch_id", "row_number") == [("keep", 2), ("keep", 3), ("once", 2)]


def test_incomplete_duplicate_is_dropped_with_its_time(spark):
    """The first of two rows with one timestamp wins, then falls to the drop strategy."""
    rows = [("b", 2, minute(0), "s", None), ("b", 3, minute(0), "s", 2.0), ("b", 4, minute(1), "s", 4.0)]
    config = with_option_defaults(spark.createDataFrame([("b", "drop")], "batch_id STRING, strategy STRING"))
    result = process(spark.createDataFrame(rows, READING_SCHEMA), config)
    assert rows_of(result.imputed, "row_number") == [(4,)]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 13])
@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 28, 100])
def test_even_sample_equals_linspace(spark, n, rows_per_slice):
    readings = series_frame(spark, {("b", "s"): [float(i) for i in range(n)]})
    found = sorted(r.idx for r in replay.even_sample(readings, 10, rows_per_slice).collect())
    assert found == sorted(set(np.linspace(0, n - 1, min(10, n), dtype=int).tolist()))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_result_does_not_depend_on_partitions(spark, partitions):
    readings = series_frame(spark, random_series(7)).repartition(6)
    config = with_option_defaults(readings.select("batch_id").distinct())
    base = rows_of(process(readings, config).metrics.withColumn("metric_value", F.round("metric_value", 9)), "batch_id", "sensor", "metric_name", "metric_value")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = process(readings.repartition(3), config).metrics.withColumn("metric_value", F.round("metric_value", 9))
        assert rows_of(again, "batch_id", "sensor", "metric_name", "metric_value") == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


# --- infinite cells -----------------------------------------------------------------


def test_infinite_cells_do_not_mark_their_series(spark):
    inf = math.inf
    readings = series_frame(spark, {("f", "a"): [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, inf], ("f", "b"): [-inf, -inf, -inf, 1.0, 2.0, inf, inf, inf]})
    stats = metrics.series_stats(readings)
    assert anomaly.zscore_anomalies(readings, stats).count() == 0
    # the quartiles of a are finite, those of b are not
    assert rows_of(anomaly.iqr_anomalies(readings, stats), "sensor", "value") == [("a", inf)]
    for method, marked in (("zscore", 0), ("iqr", 1)):
        assert anomaly.anomalies_by_config(readings, stats, default_config(spark, method=method)).count() == marked
    assert sum(r.anomalies for r in anomaly.threshold_sweep(readings, stats, [1.0, 3.0]).collect()) == 0


# --- sketches and mixed plans -------------------------------------------------------


def long_series(spark, rows=40_000):
    return spark.range(rows).select(
        F.lit("b").alias("batch_id"), F.col("id").alias("row_number"), F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("sensor"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.col("id") * 7919, F.lit(10007)).cast("double")).alias("value"))


def test_sketch_errors_are_bounded_and_sketches_merge(spark):
    from batchgauge.operators import sketches

    readings = long_series(spark).unionByName(long_series(spark, 300).withColumn("batch_id", F.lit("small")))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    whole = sketches.series_sketches(readings)
    runs = sketches.series_sketches(readings.withColumn("run", F.col("row_number") % 3), ["run", "batch_id", "sensor"])
    together = sketches.merged(runs, ["batch_id", "sensor"])
    for made in (whole, together):
        errors = sketches.measured_error(readings, sketches.sketch_quantiles(made, shares), shares)
        for row in errors.collect():
            bound = sketches.rank_error() + 1 / row.n if row.batch_id == "b" else 1 / row.n
            assert max(row.q1_error, row.median_error, row.q3_error) <= bound
        assert {(r.batch_id, r.n) for r in made.collect()} == {("b", 16_000), ("small", 120)}
    stats = {r.batch_id: r for r in sketches.sketch_stats(together).where("sensor = 's1'").collect()}
    assert stats["b"]["min"] >= 0 and stats["b"]["max"] <= 10006 and stats["b"]["range"] == stats["b"]["max"] - stats["b"]["min"]


def test_one_large_series_leaves_the_plan_of_the_others_alone(spark):
    from batchgauge.functions.settings import with_option_defaults
    from batchgauge.plans import process as run

    small = long_series(spark, 600).withColumn("batch_id", F.concat(F.lit("n"), F.floor(F.col("row_number") / 100).cast("string")))
    readings = small.unionByName(long_series(spark, 3000))
    config = with_option_defaults(readings.select("batch_id").distinct().withColumn(
        "strategy", F.when(F.col("batch_id") == "n1", "drop").when(F.col("batch_id") == "n2", "ffill").otherwise("interpolate")))
    plain, mixed = run.process(readings, config), run.process(readings, config, 200, 200)

    def rows(df):
        return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())

    for name in ("imputed", "metrics", "anomalies", "counters"):
        columns = getattr(plain, name).columns
        assert rows(getattr(plain, name)) == rows(getattr(mixed, name).select(*columns)), name
    ordinary, large = run.routes(readings, 200)
    assert not ordinary.cut and large.cut and large.largest == 1500
    assert {r.batch_id for r in ordinary.of(readings).select("batch_id").distinct().collect()} == {f"n{i}" for i in range(6)}
    assert {r.batch_id for r in large.of(readings).select("batch_id").distinct().collect()} == {"b"}
    assert [r.cut for r in run.routes(readings, 10_000)] == [False]
