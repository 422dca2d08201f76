"""File fingerprints and package checks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchgauge.functions.settings import version_compatible
from batchgauge.session import materialise
from batchgauge.sources.csv_files import file_name, numbered

# Files a package must hold, and the current format versions.
SNAPSHOT_FILES = [
    "manifest.json", "config.json", "metrics.json", "anomalies.json",
    "errors.json", "source_summary.json", "dependencies.json", "checksum.json",
]
BASELINE_FILES = [
    "baseline_summary.json", "config.json", "metric_thresholds.json",
    "source_summary.json", "check_history.json", "checksum.json",
]
FORMAT_VERSION = "1.0"
CHECKSUMS = "checksum"


IN_MEMORY = 256 * 1024 * 1024
"""Largest file hashed as one value; larger ones are hashed in pieces as they are read."""


def fingerprints(spark: SparkSession, path: str, in_memory: int = IN_MEMORY) -> DataFrame:
    """Size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = [
        F.col("path").alias("file_path"),
        file_name(F.col("path")).alias("file_name"),
        F.col("length").alias("file_size"),
    ]
    # the length filter reaches the source, so contents of larger files are never loaded
    small = files.where(F.col("length") <= in_memory).select(
        *named, F.sha2("content", 256).alias("sha256")
    )
    large = files.where(F.col("length") > in_memory).select(*named)
    schema = "file_path STRING, file_name STRING, file_size BIGINT, sha256 STRING"
    return small.unionByName(large.mapInPandas(_hash_in_pieces, schema))


def _hash_in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 needs the bytes in order: one task per file, a few megabytes at a time."""
    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch["file_path"]:
            system, inner = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", uri), safe=":/%"))
            digest = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while piece := stream.read(8 * 1024 * 1024):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


BLOCK_LINES = 100_000
"""Lines of a block of the tree digest."""
NODE_BLOCKS = 10_000
"""Block digests under one inner node."""


def _joined(order: str, digest: str):
    """SHA-256 over digests in their order; a group holds a bounded number of them."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(digest).alias("digest"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["digest"]), ""), 256)


def block_digests(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``file_path, block, first_line, lines, sha256`` for every block of lines of the files below ``path``.

    Files are read by Spark's own splits, so a file of any size is hashed by many tasks, with the
    access the session has. A line is hashed with the bytes it has, up to its line feed; a block's digest
    is that over the digests of its lines. Blocks are counted in lines, so they do not depend on the splits.
    """
    raw = materialise(spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"), F.sha2(F.col("value").cast("binary"), 256).alias("digest")))
    lines = numbered(raw).withColumn("block", F.floor((F.col("row_number") - 1) / block_lines))
    return lines.groupBy("file_path", "block").agg(
        F.min("row_number").alias("first_line"), F.count(F.lit(1)).alias("lines"), _joined("row_number", "digest").alias("sha256"))


def tree_digests(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES, blocks: DataFrame | None = None) -> DataFrame:
    """``file_path, file_name, file_size, lines, tree_sha256`` of every file below ``path`` that is
    not empty (Spark's readers pass over empty ones, ``csv_files.listed_files`` names them).

    The root covers the size, the lines to a block and the block digests (``blocks``: those of
    ``block_digests``, if they are there already), by way of inner nodes of ``NODE_BLOCKS`` blocks. One path
    serves all sizes. It stands beside the plain SHA-256 of ``fingerprints``, which tools outside know.
    """
    if blocks is None:
        blocks = block_digests(spark, path, block_lines)
    nodes = blocks.withColumn("node", F.floor(F.col("block") / NODE_BLOCKS)).groupBy("file_path", "node").agg(
        F.sum("lines").alias("lines"), _joined("block", "sha256").alias("digest"))
    roots = nodes.groupBy(F.col("file_path").alias("_path")).agg(F.sum("lines").alias("lines"), _joined("node", "digest").alias("digest"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = listed.select(F.col("_metadata.file_path").alias("_path"), "length")  # contents are not read
    return files.join(roots, "_path", "left").select(
        F.col("_path").alias("file_path"), file_name(F.col("_path")).alias("file_name"), F.col("length").alias("file_size"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.sha2(F.concat_ws(":", F.lit(str(block_lines)), F.col("length").cast("string"), F.coalesce("digest", F.lit(""))), 256).alias("tree_sha256"))


def changed_blocks(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Blocks that differ between two listings of ``block_digests``: ``keys, block, change`` (added,
    removed, modified). ``keys`` name a file in both, by default its path."""
    keys = keys or ["file_path"]
    old, new = (side.select(*keys, "block", F.col("sha256").alias(name)) for side, name in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, [*keys, "block"], "full_outer").select(*keys, "block", change.alias("change")).where("change IS NOT NULL")


def package_parts(files: list[str]) -> list[str]:
    """The names of the parts that hold the contents of these files."""
    return [name.removesuffix(".json") for name in files]


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``file_name`` (``part/file``), ``file_size``, ``sha256`` of a package written as one
    folder per part."""
    found = fingerprints(spark, path)
    part = F.element_at(F.split("file_path", "/"), -2)
    return found.select(
        part.alias("part"), F.concat_ws("/", part, "file_name").alias("file_name"), "file_size", "sha256")


def check_written(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Problems (``file_name``, ``problem``) of a package written by ``sinks.exports.write_package``:
    parts that lack, files listed but absent, changed or not listed."""
    actual = package_files(spark, path)
    parts = package_parts(required)
    present = {r.part for r in actual.where(F.col("part").isin(parts)).select("part").distinct().collect()}
    problems = spark.createDataFrame(
        [(p, "missing_file") for p in parts if p not in present], "file_name STRING, problem STRING")
    if CHECKSUMS not in present:
        return problems
    listed = spark.read.schema("file_name STRING, file_size BIGINT, sha256 STRING").json(f"{path}/{CHECKSUMS}")
    found = actual.where(F.col("part") != CHECKSUMS).select("file_name", F.col("sha256").alias("found"))
    problem = (
        F.when(F.col("found").isNull(), "missing_file").when(F.col("sha256").isNull(), "unlisted_file")
        .when(F.col("sha256") != F.col("found"), "checksum_mismatch")
    )
    both = listed.join(found, "file_name", "full_outer").select("file_name", problem.alias("problem"))
    return problems.unionByName(both.where("problem IS NOT NULL"))


def check_packages(actual: DataFrame, listed: DataFrame, required: list[str]) -> DataFrame:
    """Problems of unpacked packages.

    ``actual``: ``package, file_name, sha256`` as found; ``listed``: the same columns as
    the package's checksum file states them. A listed file that is absent is only a
    problem when it is required.
    """
    wanted = actual.select("package").distinct().select(
        "package", F.explode(F.array(*[F.lit(n) for n in required])).alias("file_name")
    )
    missing = wanted.join(actual, ["package", "file_name"], "left_anti").select(
        "package", "file_name", F.lit("missing_file").alias("problem")
    )
    found = actual.select("package", "file_name", F.col("sha256").alias("found"))
    broken = (
        listed.where(F.col("file_name") != "checksum.json")
        .join(found, ["package", "file_name"])
        .where(F.col("sha256") != F.col("found"))
        .select("package", "file_name", F.lit("checksum_mismatch").alias("problem"))
    )
    return missing.unionByName(broken)


def incompatible_packages(manifests: DataFrame, current: str = FORMAT_VERSION) -> DataFrame:
    """Packages (``package, format_version``) of another major format version."""
    version = F.coalesce("format_version", F.lit("0.0"))
    return manifests.where(~version_compatible(version, current)).select(
        "package", F.lit("format_version").alias("file_name"), F.lit("incompatible_format").alias("problem")
    )
