import math

import pytest
from pyspark.sql import functions as F

from batchgauge.functions.text import is_number, parse_number, parse_time
from batchgauge.operators import validate
from batchgauge.sources import csv_files
from helpers import SAMPLE, lines_frame, minute, rows_of


def parsed(spark, text):
    return csv_files.scan(lines_frame(spark, {"f": text}))


def test_sample_errors(spark):
    errors = validate.row_errors(parsed(spark, SAMPLE))
    assert rows_of(errors, "row_number", "error_type") == [(10, "missing_timestamp"), (7, "non_numeric_value")]
    raw = {r.row_number: r.raw_data for r in errors.collect()}
    assert raw[10] == ",5.1,223,1.36"


def test_sample_readings(spark):
    readings = validate.readings_of(parsed(spark, SAMPLE))
    assert readings.count() == 17 * 3
    missing = readings.where("value IS NULL")
    assert rows_of(missing, "row_number", "sensor") == [
        (5, "level"), (7, "flow"), (9, "power"),
    ]


def test_error_kinds_exclude_each_other(spark):
    text = "a,timestamp\n1,2025-01-01\n1,2025-01-01,9\n,\nx,never\nx,2025/01/01 10:00:00\n\n  \n5,2025-01-01T00:00:01.5\n"
    rows = parsed(spark, text)
    assert rows_of(validate.row_errors(rows), "row_number", "error_type") == [
        (3, "column_mismatch"), (4, "missing_timestamp"), (5, "invalid_timestamp"), (6, "non_numeric_value"),
    ]
    readings = validate.readings_of(rows)
    assert rows_of(readings, "row_number", "value") == [(2, 1.0), (6, None), (9, 5.0)]
    assert rows_of(validate.cell_errors(rows), "row_number") == [(6,)]
    assert rows_of(validate.row_level_errors(rows, "column_mismatch"), "row_number") == [(3,)]


def test_two_bad_cells_are_two_errors_of_one_row(spark):
    from batchgauge.operators.metrics import run_counters

    rows = parsed(spark, "timestamp,a,b\n2025-01-01,x,y\n2025-01-02,1,2\n")
    counted = run_counters(validate.readings_of(rows), validate.row_errors(rows)).first()
    assert (counted.rows_processed, counted.error_records, counted.error_rows) == (2, 2, 1)


@pytest.mark.parametrize("text, value, number", [
    ("1", 1.0, True), ("-1.5e3", -1500.0, True), (".5", 0.5, True), ("5.", 5.0, True), ("+7", 7.0, True),
    ("1_000", 1000.0, True), ("1__0", None, False), ("_1", None, False), ("1.0d", None, False),
    ("1f", None, False), ("0x10", None, False), ("nan", None, True), ("-NaN", None, True),
    ("inf", math.inf, True), ("-Infinity", -math.inf, True), ("+inf", math.inf, True),
    ("1e400", math.inf, True), ("abc", None, False), ("1 2", None, False),
])
def test_numbers(spark, text, value, number):
    row = spark.createDataFrame([(text,)], "t STRING").select(
        parse_number(F.col("t")).alias("v"), is_number(F.col("t")).alias("n")).first()
    assert (row.v, row.n) == (value, number)


def test_time_formats(spark):
    good = {
        "2025-01-01 00:01:00": minute(1), "2025-01-01T00:01:00": minute(1),
        "2025-01-01 00:01:00.0": minute(1), "2025-01-01T00:01:00.000000": minute(1),
        "2025/01/01 00:01:00": minute(1), "2025-01-01": minute(0),
    }
    bad = ["", "now", "2025", "12:00", "2025-13-01", "2025-02-30", "2025/01/01", "2025-01-01 25:00:00", "20250101"]
    frame = spark.createDataFrame([(t,) for t in [*good, *bad]], "t STRING")
    found = {r.t: r.v for r in frame.select("t", parse_time(F.col("t")).alias("v")).collect()}
    assert found == {**good, **dict.fromkeys(bad)}


def test_rejected_files(spark):
    files = {
        "ok": "timestamp,a\n2025-01-01,1\n", "no_time": "time,a\n2025-01-01,1\n",
        "no_sensor": "timestamp\n2025-01-01\n", "twice": "timestamp,a,a\n2025-01-01,1,2\n",
        "all_bad": "timestamp,a\nnever,1\n,2\n", "blank_sensors": "timestamp,a\n2025-01-01,x\n", "blank_head": "\n2025-01-01,1\n",
    }
    names = spark.createDataFrame([(n,) for n in [*files, "empty"]], "batch_id STRING")
    rejected = validate.rejected_files(names, lines_frame(spark, files))
    assert dict(rows_of(rejected, "batch_id", "reason")) == {
        "no_time": "missing_timestamp_column", "no_sensor": "no_sensor_column", "twice": "duplicate_column",
        "all_bad": "no_valid_rows", "empty": "empty_file", "blank_head": "missing_timestamp_column",
    }


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("b", 2, minute(0), 1.0, None)], "batch_id STRING, row_number BIGINT, ts TIMESTAMP_NTZ, x DOUBLE, y DOUBLE")
    long = validate.wide_to_long(wide, ["x", "y"])
    assert rows_of(long, "sensor", "value") == [("x", 1.0), ("y", None)]
    assert validate.long_to_wide(long, ["x", "y"]).collect() == wide.collect()


def test_lenient_times_are_read_row_by_row(spark):
    loose = {
        "2025-01-01 00:00": "2025-01-01 00:00:00", "2025-1-2 3:04": "2025-01-02 03:04:00", "2025/01/02": "2025-01-02 00:00:00",
        "05/06/2025": "2025-05-06 00:00:00", "5/6/2025 07:08:09.5": "2025-05-06 07:08:09.500000", "20250101": "2025-01-01 00:00:00",
        "20250101T101112": "2025-01-01 10:11:12", "202501011011": "2025-01-01 10:11:00", "2025.01.02 01:02:03": "2025-01-02 01:02:03",
        "2025-13-01": None, "31/12/2025": None, "20250230": None, "now": None, "12:00": None, "2025": None, "2025-01-01 25:00": None, "": None}
    strict = {"2025-01-01 01:02:03": "2025-01-01 01:02:03", "2025/01/01 01:02:03": "2025-01-01 01:02:03", "2025-01-01": "2025-01-01 00:00:00"}
    rows = spark.createDataFrame([(t,) for t in [*loose, *strict]], "t STRING")
    found = {r.t: (r.s, r.l) for r in rows.select("t", parse_time(F.col("t")).alias("s"), parse_time(F.col("t"), True).alias("l")).collect()}
    assert {t: None if l is None else str(l) for t, (_, l) in found.items()} == loose | strict
    assert {t for t, (s, _) in found.items() if s is not None} == set(strict)
    lines = lines_frame(spark, {"f": "timestamp,a\n2025-01-01 00:00,1\n2025-01-01 00:01:00,2\n5/6/2025,3\nnever,4\n"})
    for lenient, bad in ((False, [2, 4, 5]), (True, [5])):
        errors = validate.row_errors(csv_files.scan(lines, lenient))
        assert rows_of(errors, "row_number", "error_type") == [(n, "invalid_timestamp") for n in bad]
