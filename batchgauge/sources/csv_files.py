"""Sensor CSV files as numbered lines.

Files are read as splittable text, so one file of any size is spread over many tasks.
The line number is the number of lines in earlier splits of the file plus the place
inside the split; only one small row per split is aggregated for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchgauge.operators.slicing import stored_small
from batchgauge.operators.validate import headers_of, parsed_rows
from batchgauge.session import materialise

BLOCK = ["file_path", "block_start"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path, row_number, line`` for every physical line, header = line 1."""
    # Stored once: another scan may cut the files elsewhere, as the cut follows the executors present.
    raw = materialise(spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    ))
    return (
        numbered(raw).select("file_path", "row_number", "line")
        .withColumn("line", F.when(
            F.col("row_number") == 1, F.regexp_replace("line", "^﻿", "")
        ).otherwise(F.col("line")))
    )


def numbered(stored: DataFrame) -> DataFrame:
    """Add ``row_number``, the line number in its file, to stored lines with ``file_path, block_start,
    place``: the lines of earlier splits of the file, and the place within the split."""
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = stored_small(
        stored.groupBy(*BLOCK)
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))
        .select(*BLOCK, "first_place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    number = F.col("place") - F.col("first_place") + F.col("before") + 1
    return stored.join(blocks, BLOCK).withColumn("row_number", number)


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path`` of every file, from the listing Spark makes when it opens the paths.

    A scan skips empty files, so it cannot tell that one exists; the listing can.
    """
    names = spark.read.text(paths).inputFiles()
    return spark.createDataFrame([(n,) for n in names], "file_path STRING")


def scan(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """Parsed rows, with their row-level errors, of numbered lines; ``lenient`` reads more spellings of a
    timestamp.

    The headers (one row per file) are stored and counted first, so the lines themselves
    are not shuffled for the join while the list of files is of ordinary length.
    """
    return parsed_rows(lines, stored_small(headers_of(lines)), lenient)

