"""Batch configuration: defaults, JSON reading, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.functions.json_text import json_with_version

# Sections a configuration must have, and the defaults of its options.
REQUIRED_SECTIONS = ["cleaning", "missing_values", "anomaly_detection", "metrics"]
DEFAULTS = {
    "version": 1,
    "remove_duplicates": True,
    "strategy": "interpolate",
    "numeric_fill_value": 0.0,
    "max_interpolate_gap": 5,
    "compute_mean": True,
    "compute_std": True,
    "compute_min": True,
    "compute_max": True,
    "compute_median": True,
    "compute_range": True,
    "method": "zscore",
    "zscore_threshold": 3.0,
    "iqr_multiplier": 1.5,
    "min_values": 5,
}
FLAGGED_METRICS = ["mean", "std", "min", "max", "median", "range"]

CONFIG_SCHEMA = (
    "version INT, "
    "cleaning STRUCT<remove_duplicates: BOOLEAN, trim_whitespace: BOOLEAN>, "
    "missing_values STRUCT<strategy: STRING, numeric_fill_value: DOUBLE, max_interpolate_gap: INT>, "
    "metrics STRUCT<compute_mean: BOOLEAN, compute_std: BOOLEAN, compute_min: BOOLEAN, "
    "compute_max: BOOLEAN, compute_median: BOOLEAN, compute_range: BOOLEAN>, "
    "anomaly_detection STRUCT<method: STRING, zscore_threshold: DOUBLE, iqr_multiplier: DOUBLE, min_values: INT>"
)

SECTION_OF = {
    "remove_duplicates": "cleaning",
    "strategy": "missing_values",
    "numeric_fill_value": "missing_values",
    "max_interpolate_gap": "missing_values",
    "method": "anomaly_detection",
    "zscore_threshold": "anomaly_detection",
    "iqr_multiplier": "anomaly_detection",
    "min_values": "anomaly_detection",
    **{f"compute_{m}": "metrics" for m in FLAGGED_METRICS},
}


def read_config(df: DataFrame, json_column: str = "config_json") -> DataFrame:
    """Replace a JSON column by one flat column per option, defaults filled in."""
    parsed = df.withColumn("_cfg", F.from_json(json_column, CONFIG_SCHEMA))
    options = [
        F.coalesce(
            F.col(f"_cfg.{SECTION_OF[name]}.{name}" if name in SECTION_OF else f"_cfg.{name}"),
            F.lit(default),
        ).alias(name)
        for name, default in DEFAULTS.items()
    ]
    return parsed.select(*[c for c in df.columns if c != json_column], *options)


def with_option_defaults(df: DataFrame) -> DataFrame:
    """Fill options that are NULL or missing as columns of a flat configuration table."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        for name, default in DEFAULTS.items()
    })


def missing_sections(config_json: Column) -> Column:
    """Required sections the configuration lacks, in their fixed order."""
    required = F.array(*[F.lit(s) for s in REQUIRED_SECTIONS])
    present = F.coalesce(F.json_object_keys(config_json), F.array().cast("array<string>"))
    return F.array_except(required, present)


def version_compatible(version: Column, current: str) -> Column:
    """Equal, or the same part before the first dot; NULL versions are incompatible."""
    return F.coalesce(
        (version == F.lit(current)) | (F.split(version, r"\.")[0] == F.lit(current.split(".")[0])),
        F.lit(False),
    )


def with_version(config_json: Column, version: Column) -> Column:
    """The same configuration text with its top-level version replaced or added."""
    return json_with_version(config_json, version.cast("string"))


def config_version(config_json: Column) -> Column:
    return F.get_json_object(config_json, "$.version").try_cast("bigint")
