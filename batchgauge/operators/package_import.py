"""Import of whole packages (baselines, snapshots) into a registry with unique names.

A package is a set of tables that share a key, as ``sources.documents.read_package`` gives them after its
check. The decision on every entry is that of ``merge.merge_decisions``; entries that are stored get new
ids, and every other table follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.drift import last_checks
from batchgauge.operators.merge import merge_decisions
from batchgauge.operators.slicing import with_numbers
from batchgauge.session import materialise

# The policies of packages, and the log entries.
POLICIES = ("reject", "rename", "skip")
BASELINE_IMPORT, SNAPSHOT_IMPORT = "baseline_import", "snapshot_import"


def import_entries(
    existing: DataFrame, entries: DataFrame, key: str, policy: str, action: str, imported_from: str,
    attached: dict[str, DataFrame] | None = None, skipped: str = "blocked",
) -> dict[str, DataFrame]:
    """Rows to append when the ``entries`` of a package are imported in order of their key.

    ``existing``: ``id, name``; ``entries``: ``key``, ``name``, optionally ``new_name`` (for renaming), and
    what else they hold; ``attached``: further tables with the column ``key``. Returns ``decisions``
    (``key, name, action, final_name, new_id``), ``entries`` with the new ``key``, ``name``,
    ``original_name``, ``original_id`` (the key in the package) and ``imported_from``, every attached table under the
    new key, and ``audit_log`` with one row per entry; ``skipped`` is the result that skipped entries have there.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    named = ["new_name"] if policy == "rename" and "new_name" in entries.columns else []
    incoming = materialise(entries.select(F.col(key).alias("seq"), "name", *named))
    decided = materialise(merge_decisions(existing, incoming, policy))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = with_numbers(decided.where("final_name IS NOT NULL"), "seq", "seq").select("seq", (F.col("pos") + top).alias("new_id"))
    decisions = materialise(decided.join(numbered, "seq", "left").select(
        F.col("seq").alias(key), "name", "action", "final_name", F.col("target_id").alias("existing_id"), "new_id"))
    ids = decisions.where("new_id IS NOT NULL").select(key, "new_id", "final_name")

    def renumbered(table: DataFrame) -> DataFrame:
        return table.join(ids.select(key, "new_id"), key).select(
            F.col("new_id").alias(key), *[F.col(c) for c in table.columns if c != key])

    kept = [c for c in entries.columns if c not in (key, "name", "new_name", "original_name", "original_id", "imported_from")]
    stored = entries.join(ids, key).select(
        F.col("new_id").alias(key), F.col("final_name").alias("name"), *kept, F.col("name").alias("original_name"),
        F.col(key).alias("original_id"), F.lit(imported_from).alias("imported_from"))
    result = F.when(F.col("new_id").isNotNull(), "success").when(F.col("action") == "skip", skipped).otherwise("blocked")
    audit = decisions.select(
        F.lit(action).alias("action"), F.col(key).alias("original_id"), F.col("new_id").alias(key), F.col("name").alias("original_name"), "final_name",
        F.when(F.col("action") != "insert", F.col("action")).alias("conflict_action"), result.alias("result"),
        F.when(F.col("new_id").isNull(), "name_exists").alias("error_message"), F.lit(imported_from).alias("imported_from"))
    tables = {name: renumbered(table) for name, table in (attached or {}).items()}
    return {"decisions": decisions, "entries": stored, **tables, "audit_log": audit}


def import_baselines(existing: DataFrame, package: dict[str, DataFrame], policy: str, imported_from: str) -> dict[str, DataFrame]:
    """A baseline package (``sinks.exports.baseline_package``) into the registry ``existing`` (``id, name``).

    Imported baselines name no batch and no run of this registry; configuration, thresholds and source summary
    come along. Of the check history the newest status stays, as ``last_check_status``; the checks themselves
    are those of the registry they were made in.
    """
    newest = last_checks(package["check_history"], 1).select("baseline_id", F.col("check_status").alias("last_check_status"))
    config = package["config"].select("baseline_id", "config_json")
    own = package["baseline_summary"].drop("check_history_count", "last_check_status", "config_json")
    entries = own.join(config, "baseline_id", "left").join(newest, "baseline_id", "left").withColumns({
        c: F.lit(None).cast(own.schema[c].dataType) for c in ("source_batch_id", "source_run_id") if c in own.columns})
    made = import_entries(
        existing, entries, "baseline_id", policy, BASELINE_IMPORT, imported_from,
        {name: package[name] for name in ("metric_thresholds", "source_summary")}, skipped="success")
    made["baselines"] = made.pop("entries")
    return made


def import_snapshots(existing: DataFrame, package: dict[str, DataFrame], policy: str, imported_from: str) -> dict[str, DataFrame]:
    """A snapshot package (``sinks.exports.snapshot_package``) into the registry ``existing`` (``id, name``).

    A snapshot is a stored run; it is named after its batch and run number. Its metrics, anomalies, errors
    and configuration come along under the new id, so that a replay can be compared with them.
    """
    name = F.concat_ws(" #", "batch_name", F.col("run_number").cast("string"))
    entries = package["manifest"].drop("config_json", "config_sha256").withColumn("name", name)
    made = import_entries(
        existing, entries, "run_id", policy, SNAPSHOT_IMPORT, imported_from,
        {part: package[part] for part in ("config", "metrics", "anomalies", "errors")})
    made["snapshots"] = made.pop("entries")
    return made
