"""Row validation: raw lines to readings and row errors.

Lines: ``batch_id, row_number, line`` with the physical line number, line 1 being the
header. Headers: one row per batch with the trimmed column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.functions.text import is_number, parse_number, parse_time, strip
from batchgauge.operators.slicing import stored_small

TIME_COLUMN = "timestamp"


def headers_of(lines: DataFrame) -> DataFrame:
    """Column names per batch, from line 1."""
    names = F.transform(F.split(strip(F.col("line")), ","), strip)
    return lines.where("row_number = 1").select("batch_id", names.alias("headers"))


def header_problem(headers: Column) -> Column:
    """Why a header line is unusable, NULL when it is fine."""
    return (
        F.when(~F.array_contains(headers, TIME_COLUMN), "missing_timestamp_column")
        .when(F.size(headers) < 2, "no_sensor_column")
        .when(F.size(F.array_distinct(headers)) < F.size(headers), "duplicate_column")
    )


def parsed_rows(lines: DataFrame, headers: DataFrame, lenient: bool = False) -> DataFrame:
    """Non-blank data lines of usable files, split, with ``ts`` and the row-level error. ``lenient``
    takes more spellings of a timestamp (``functions.text.parse_time``).

    The three row-level errors exclude each other in this order: wrong number of cells,
    blank timestamp, unreadable timestamp.
    """
    usable = headers.where(header_problem(F.col("headers")).isNull())
    text = strip(F.col("line"))
    raw_time = strip(F.get(F.col("cells"), F.array_position("headers", F.lit(TIME_COLUMN)).cast("int") - 1))
    kind = (
        F.when(F.size("cells") != F.size("headers"), "column_mismatch")
        .when(F.col("raw_time") == "", "missing_timestamp")
        .when(F.col("ts").isNull(), "invalid_timestamp")
    )
    return (
        lines.where(F.col("row_number") > 1)
        .select("batch_id", "row_number", text.alias("line"))
        .where(F.col("line") != "")
        .join(usable, "batch_id")
        .withColumn("cells", F.split("line", ",", -1))
        .withColumn("raw_time", raw_time)
        .withColumn("ts", parse_time(F.col("raw_time"), lenient))
        .withColumn("row_error", kind)
    )


def cell_rows(rows: DataFrame) -> DataFrame:
    """One row per sensor cell of every accepted row: stripped text and numeric value."""
    pairs = F.filter(
        F.arrays_zip(F.col("headers").alias("sensor"), F.col("cells").alias("raw")),
        lambda pair: pair["sensor"] != TIME_COLUMN,
    )
    raw = strip(F.col("cell.raw"))
    return (
        rows.where(F.col("row_error").isNull())
        .select("batch_id", "row_number", "ts", F.explode(pairs).alias("cell"))
        .select(
            "batch_id", "row_number", "ts",
            F.col("cell.sensor").alias("sensor"),
            raw.alias("raw"),
            parse_number(raw).alias("value"),
        )
    )


def readings_of(rows: DataFrame) -> DataFrame:
    """Long readings; blank and unreadable cells are NULL, the row is kept."""
    return cell_rows(rows).select("batch_id", "row_number", "ts", "sensor", "value")


def _row_detail() -> Column:
    return (
        F.when(
            F.col("row_error") == "column_mismatch",
            F.format_string("expected %d columns, found %d", F.size("headers"), F.size("cells")),
        )
        .when(F.col("row_error") == "missing_timestamp", "timestamp is blank")
        .otherwise(F.format_string("cannot read timestamp '%s'", F.col("raw_time")))
    )


def row_level_errors(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Errors that reject a whole row, optionally of one kind."""
    wanted = F.col("row_error").isNotNull() if kind is None else F.col("row_error") == kind
    return rows.where(wanted).select(
        "batch_id", "row_number", F.col("row_error").alias("error_type"),
        _row_detail().alias("error_detail"), F.col("line").alias("raw_data"),
    )


def _bad_cells() -> Column:
    """The sensor cells of an accepted row that are neither blank nor a number."""
    cells = F.transform(
        F.arrays_zip(F.col("headers").alias("sensor"), F.col("cells").alias("raw")),
        lambda c: F.struct(c["sensor"].alias("sensor"), strip(c["raw"]).alias("raw")),
    )
    return F.filter(
        cells, lambda c: (c["sensor"] != TIME_COLUMN) & (c["raw"] != "") & ~is_number(c["raw"])
    )


def row_errors(rows: DataFrame) -> DataFrame:
    """The complete error table of a run, from one pass over the rows: the row-level error
    of a rejected row, or one error per bad cell of an accepted row."""
    whole = F.array(F.struct(F.col("row_error").alias("kind"), _row_detail().alias("detail")))
    per_cell = F.transform(_bad_cells(), lambda c: F.struct(
        F.lit("non_numeric_value").alias("kind"),
        F.format_string("value of sensor %s is not a number: '%s'", c["sensor"], c["raw"]).alias("detail"),
    ))
    found = F.when(F.col("row_error").isNotNull(), whole).otherwise(per_cell)
    return rows.select("batch_id", "row_number", "line", F.explode(found).alias("e")).select(
        "batch_id", "row_number", F.col("e.kind").alias("error_type"),
        F.col("e.detail").alias("error_detail"), F.col("line").alias("raw_data"),
    )


def cell_errors(rows: DataFrame) -> DataFrame:
    """One error per cell that is neither blank nor a number; the row itself is kept."""
    return row_errors(rows.where(F.col("row_error").isNull()))


def rejected_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files that cannot be used, with the reason.

    ``files`` lists every file (``batch_id``), so one without any line shows up as empty.
    """
    headers = stored_small(headers_of(lines))  # so the lines are not shuffled for it
    good = (
        parsed_rows(lines, headers)
        .where(F.col("row_error").isNull())
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("good_rows"))
    )
    reason = (
        F.when(F.col("headers").isNull(), "empty_file")
        .when(header_problem(F.col("headers")).isNotNull(), header_problem(F.col("headers")))
        .when(F.col("good_rows").isNull(), "no_valid_rows")
    )
    return (
        files.select("batch_id")
        .join(headers, "batch_id", "left")
        .join(good, "batch_id", "left")
        .select("batch_id", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def wide_to_long(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """Wide frame (``batch_id, row_number, ts`` and sensor columns) to readings."""
    return rows.unpivot(["batch_id", "row_number", "ts"], sensors, "sensor", "value")


def long_to_wide(readings: DataFrame, sensors: list[str]) -> DataFrame:
    """Readings back to one row per source row."""
    return (
        readings.groupBy("batch_id", "row_number", "ts")
        .pivot("sensor", sensors)
        .agg(F.first("value"))
    )
