"""Exchange documents: scheme files, ticket files, stored result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchgauge.sources.integrity import CHECKSUMS, check_written, package_parts

SCHEME_FILE = (
    "name STRING, description STRING, scheme_version STRING, config STRING, "
    "source_scheme_id BIGINT, original_id BIGINT, exported_at STRING"
)
NOTE = "STRUCT<author: STRING, note_type: STRING, content: STRING, created_at: STRING>"
TICKET_FILE = (
    "format_version STRING, title STRING, source_batch_id BIGINT, source_run_id BIGINT, "
    "trigger_rule STRING, status STRING, assignee STRING, resolution STRING, "
    f"original_ticket_id BIGINT, notes ARRAY<{NOTE}>, "
    "created_at STRING, updated_at STRING, exported_at STRING, part BIGINT, notes_before BIGINT"
)


def read_schemes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per scheme file, or per line as ``sinks.exports.write_json`` writes them; ``config`` stays
    JSON text for the section check."""
    return _with_origin(spark.read.schema(SCHEME_FILE).json(path, multiLine=not lines))


def read_ticket_parts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Every exchange document: one a file, or one a line as ``sinks.exports.write_json`` writes them."""
    return _with_origin(spark.read.schema(TICKET_FILE).json(path, multiLine=not lines))


def read_tickets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per ticket: the first part of a ticket whose timeline goes on in further ones.
    ``ticket_notes`` of all parts gives the whole timeline."""
    return read_ticket_parts(spark, path, lines).where("coalesce(part, 0) = 0")


def _with_origin(documents: DataFrame) -> DataFrame:
    """Where an imported row came from: file, and export time if the file states it."""
    return documents.withColumn(
        "imported_from", F.concat_ws("@", F.col("_metadata.file_path"), F.col("exported_at"))
    )


def ticket_notes(tickets: DataFrame, key: str = "title") -> DataFrame:
    """Note timeline of loaded tickets or ticket parts, in document order."""
    return tickets.select(key, "notes_before", F.posexplode("notes").alias("place", "note")).select(
        key, (F.coalesce("notes_before", F.lit(0)) + F.col("place")).alias("seq"), "note.author", "note.note_type", "note.content", "note.created_at"
    )


def read_package(spark: SparkSession, path: str, required: list[str]) -> dict[str, DataFrame]:
    """All parts of a package that passes its check; a broken one raises an error with its first problems."""
    problems = check_written(spark, path, required).limit(10).collect()
    if problems:
        raise ValueError("; ".join(f"{p.file_name}: {p.problem}" for p in problems))
    return {p: spark.read.parquet(f"{path}/{p}") for p in package_parts(required) if p != CHECKSUMS}


def read_result_set(spark: SparkSession, path: str, part: str, schema: str | None = None) -> DataFrame:
    """One part (metrics, anomalies, errors, ...) of a stored result set: Parquet as
    written by this package, or a JSON array when a schema is given."""
    if schema is None:
        return spark.read.parquet(f"{path}/{part}")
    return spark.read.schema(schema).json(f"{path}/{part}.json", multiLine=True)
