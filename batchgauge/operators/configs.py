"""Named configurations (schemes): checks, application, history, rollback, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.functions.settings import (
    config_version, missing_sections, version_compatible, with_version,
)
from batchgauge.operators.catalog import newest
from batchgauge.operators.options import config_diff, with_changes  # noqa: F401
from batchgauge.operators.slicing import left_join_known, stored_small, with_neighbours, with_numbers
from batchgauge.session import materialise

SCHEME_VERSION = "1.0"


def missing_fields(schemes: DataFrame) -> DataFrame:
    """Schemes that lack a required section, with the list of what is missing."""
    return (
        schemes.select("scheme_id", missing_sections(F.col("config_json")).alias("missing"))
        .where(F.size("missing") > 0)
        .select("scheme_id", F.array_join("missing", ",").alias("missing"))
    )


def version_check(schemes: DataFrame, current: str = SCHEME_VERSION) -> DataFrame:
    return schemes.select(
        "scheme_id", "scheme_version",
        version_compatible(F.col("scheme_version"), current).alias("compatible"),
    )


def preview(checked: DataFrame) -> DataFrame:
    """What carrying out prechecked requests would change: ``config_diff``, NULL where no new
    configuration comes about (an unknown batch or scheme, nothing to roll back to)."""
    known = F.col("old_json").isNotNull() & F.col("new_json").isNotNull()
    return with_changes(checked, "_diff").withColumn("config_diff", F.when(known, F.col("_diff"))).drop("_diff")


def dry_run_audit(checked: DataFrame) -> DataFrame:
    """One audit row for every prechecked request, of an application or a rollback."""
    return preview(checked).select(
        "request_id", "batch_id", "scheme_id", "scheme_name", "source_scheme_id", F.lit("dry_run").alias("action"),
        F.when(F.col("can_proceed"), "success").otherwise("blocked").alias("result"),
        F.col("old_json").alias("previous_config_json"), F.col("new_json").alias("new_config_json"), "config_diff",
        F.when(~F.col("can_proceed"), F.array_join(F.col("risks.risk"), ",")).alias("error_message"),
    )


def _risk(condition: Column, kind: str, severity: str = "blocker") -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("risk"), F.lit(severity).alias("severity")))


def _with_verdict(judged: DataFrame, risks: list[Column]) -> DataFrame:
    found = F.array_compact(F.array(*risks))
    blocked = F.exists(F.col("risks"), lambda r: r["severity"] == "blocker")
    return judged.withColumn("risks", found).withColumn("can_proceed", ~blocked)


def apply_precheck(
    requests: DataFrame, batches: DataFrame, schemes: DataFrame, current: str = SCHEME_VERSION, once: bool = False
) -> DataFrame:
    """Risks of applying schemes to batches, for all requests at once.

    ``requests``: ``request_id, scheme_id, batch_id, new_name, source_scheme_id`` (the
    last two may be NULL). A request whose new name several schemes have gives a row for each
    of them, or one row if ``once`` is set.
    """
    # everything that depends on one scheme or one batch is worked out before the joins
    version = F.coalesce(config_version(F.col("config_json")), F.lit(0)) + 1
    scheme = schemes.select(
        "scheme_id", F.col("name").alias("scheme_name"),
        version_compatible(F.col("scheme_version"), current).alias("compatible"),
        (F.size(missing_sections(F.col("config_json"))) > 0).alias("incomplete"),
        version.alias("next_version"),
        with_version(F.col("config_json"), version).alias("next_json"),
    )
    target = batches.select(
        "batch_id", "locked", F.col("config_json").alias("batch_config"),
        config_version(F.col("config_json")).alias("current_version"), F.lit(True).alias("has_batch"),
    )
    # the schemes are stored once and broadcast if their size allows, so requests are shuffled by
    # batch only; else NULL names and sources, which meet nothing, are spread over the tasks
    scheme = stored_small(scheme)
    taken = scheme.select(F.col("scheme_name").alias("new_name"), F.col("scheme_id").alias("name_owner"))
    if once:
        taken = stored_small(taken.groupBy("new_name").agg(F.min("name_owner").alias("name_owner")))
    source = scheme.select(
        F.col("scheme_id").alias("source_scheme_id"), F.col("scheme_name").alias("source_scheme_name")
    )
    joined = (
        requests.join(target, "batch_id", "left")
        .join(scheme, "scheme_id", "left")
        .transform(left_join_known, taken, "new_name", "request_id")
        .transform(left_join_known, source, "source_scheme_id", "request_id")
    )
    has_batch, has_scheme = F.col("has_batch").isNotNull(), F.col("next_version").isNotNull()
    both = has_batch & has_scheme
    risks = [
        _risk(~has_batch, "batch_not_found"),
        _risk(~has_scheme, "scheme_not_found"),
        _risk(has_batch & F.col("locked"), "batch_locked"),
        _risk(F.col("name_owner").isNotNull(), "name_conflict"),
        _risk(F.col("source_scheme_id").isNotNull() & F.col("source_scheme_name").isNull(), "source_missing"),
        _risk(has_scheme & ~F.col("compatible"), "version_mismatch", "warning"),
        _risk(has_scheme & F.col("incomplete"), "config_incomplete"),
    ]
    return _with_verdict(joined, risks).select(
        "request_id", "batch_id", "scheme_id", "scheme_name", "new_name",
        "source_scheme_id", "source_scheme_name", "risks", "can_proceed", "current_version",
        F.when(both, F.col("next_version")).alias("new_version"),
        F.when(both, F.col("batch_config")).alias("old_json"),
        F.when(both, F.col("next_json")).alias("new_json"),
    )


def apply_schemes(
    requests: DataFrame,
    batches: DataFrame,
    schemes: DataFrame,
    history: DataFrame,
    action: str = "apply",
    current: str = SCHEME_VERSION,
) -> dict[str, DataFrame]:
    """Rows to append when a set of requests is carried out in order of ``request_id``.

    ``action``: ``apply`` uses the scheme itself; ``clone_apply`` and ``derive_apply``
    store a copy under ``new_name`` first, and only ``derive_apply`` links the copy to its
    source. Returns the tables ``schemes``, ``config_history``, ``audit_log`` and
    ``batches`` (the new state of each changed batch).
    """
    if action not in ("apply", "clone_apply", "derive_apply"):
        raise ValueError(f"unknown action {action!r}")
    copies = action != "apply"
    checked = apply_precheck(requests, batches, schemes, current, once=copies)
    if copies:
        # the first request that is fine otherwise gets the name; only such requests are stored, and
        # the others, most of all those without a name, are never brought together by name
        fine = materialise(checked.where("can_proceed AND new_name IS NOT NULL"))
        first = stored_small(fine.groupBy("new_name").agg(F.min("request_id").alias("_first")))
        accepted = fine.join(first.select(F.col("_first").alias("request_id")), "request_id", "left_semi")
        unnamed = F.col("new_name").isNull()
        lost = F.coalesce(F.col("can_proceed") & (F.col("request_id") != F.col("_first")), F.lit(False))
        extra = F.array_compact(F.array(_risk(unnamed, "name_missing"), _risk(lost, "name_conflict")))
        checked = (
            left_join_known(checked, first, "new_name", "request_id")
            .withColumn("risks", F.concat("risks", extra))
            .withColumn("can_proceed", F.col("can_proceed") & ~unnamed & ~lost)
            .drop("_first")
        )
    else:
        # several result tables read the checked requests and the steps
        checked = materialise(checked)
        accepted = checked.where("can_proceed")

    origin = schemes.select(
        "scheme_id", "scheme_version", F.col("source_scheme_id").alias("own_source"),
        F.col("config_json").alias("scheme_config"),
    )
    accepted = accepted.join(origin, "scheme_id")
    if copies:
        placed = with_numbers(accepted, "request_id", "request_id")
        top = schemes.agg(F.coalesce(F.max("scheme_id"), F.lit(0))).first()[0]
        accepted = placed.withColumns({
            "applied_id": F.col("pos") + top, "applied_name": F.col("new_name"),
            "applied_source": F.col("scheme_id"),
        }).drop("pos")
    else:
        accepted = accepted.withColumns({
            "applied_id": F.col("scheme_id"), "applied_name": F.col("scheme_name"),
            "applied_source": F.col("own_source"),
        })
    # several requests for one batch build on each other
    chained = with_neighbours(accepted, ["batch_id"], "request_id", "request_id", "new_json")
    steps = materialise(
        chained.withColumn("old_json", F.coalesce("prev_value", "old_json")).withColumn(
            "version_regressed", F.col("new_version") < config_version(F.col("old_json"))
        )
    )
    seeds = history_seed(batches.join(accepted.select("batch_id").distinct(), "batch_id", "left_semi"), history)
    applied = steps.select(
        "request_id", "batch_id", F.col("applied_id").alias("scheme_id"),
        F.col("applied_name").alias("scheme_name"), F.col("applied_source").alias("source_scheme_id"),
        F.col("new_version").alias("config_version"), F.col("new_json").alias("config_json"),
        F.lit("apply").alias("action"), F.lit(None).cast("bigint").alias("rolled_back_from_id"),
    )
    seeded = seeds.select(
        F.lit(None).cast("bigint").alias("request_id"), "batch_id",
        F.lit(None).cast("bigint").alias("scheme_id"), F.lit(None).cast("string").alias("scheme_name"),
        F.lit(None).cast("bigint").alias("source_scheme_id"), "config_version", "config_json",
        "action", F.lit(None).cast("bigint").alias("rolled_back_from_id"),
    )
    done = with_changes(steps).select(
        "request_id", "applied_id", "applied_name", F.col("old_json").alias("before"),
        F.col("new_json").alias("after"), "version_regressed", "config_diff",
    )
    audit = (
        checked.join(done, "request_id", "left")
        .select(
            "request_id", "batch_id", F.coalesce("applied_id", "scheme_id").alias("scheme_id"),
            F.coalesce("applied_name", "scheme_name").alias("scheme_name"),
            F.lit(action).alias("action"),
            F.when(F.col("can_proceed"), "success").otherwise("blocked").alias("result"),
            F.coalesce("before", "old_json").alias("previous_config_json"),
            F.col("after").alias("new_config_json"), "config_diff", "version_regressed",
            F.array_join(F.col("risks.risk"), ",").alias("error_message"),
        )
    )
    new_schemes = accepted.select(
        F.col("applied_id").alias("scheme_id"), F.col("applied_name").alias("name"), "scheme_version",
        F.col("scheme_config").alias("config_json"),
        (F.col("scheme_id") if action == "derive_apply" else F.lit(None).cast("bigint")).alias("source_scheme_id"),
    )
    last = steps.groupBy("batch_id").agg(F.max_by(
        F.struct("applied_id", "applied_name", "new_version", "new_json"), "request_id").alias("s"))
    changed = last.select(
        "batch_id", F.col("s.applied_id").alias("current_scheme_id"),
        F.col("s.applied_name").alias("current_scheme_name"),
        F.col("s.new_version").alias("config_version"), F.col("s.new_json").alias("config_json"),
    )
    return {
        "schemes": new_schemes if copies else new_schemes.limit(0),
        "config_history": seeded.unionByName(applied),
        "audit_log": audit,
        "batches": changed,
    }


def history_seed(batches: DataFrame, history: DataFrame) -> DataFrame:
    """First history entry (``baseline``, the initial configuration) of batches without any."""
    return batches.join(history.select("batch_id").distinct(), "batch_id", "left_anti").select(
        "batch_id", "config_version", "config_json", F.lit("baseline").alias("action")
    )


def rollback_targets(history: DataFrame) -> DataFrame:
    """Newest history entry of each batch next to the one before it.

    The entry before the newest is the target whatever it is, so rolling back twice
    switches between two configurations.
    """
    fields = ["id", "scheme_id", "scheme_name", "source_scheme_id", "config_version", "config_json"]
    entry = F.struct(*fields)
    two = newest(history, "batch_id", "id", 2)
    pairs = two.groupBy("batch_id").agg(
        F.max(F.when(F.col("newest_rank") == 1, entry)).alias("latest"),
        F.max(F.when(F.col("newest_rank") == 2, entry)).alias("target"),
    )
    return pairs.select(
        "batch_id",
        *[F.col(f"latest.{f}").alias(f"latest_{f}") for f in fields],
        *[F.col(f"target.{f}").alias(f"target_{f}") for f in fields],
    )


def rollback_precheck(requests: DataFrame, batches: DataFrame, history: DataFrame) -> DataFrame:
    """Risks of rolling batches back, with the version a rollback would get.

    ``requests``: ``batch_id``, and ``request_id`` if there is one (else the batch's id).
    """
    if "request_id" not in requests.columns:
        requests = requests.withColumn("request_id", F.col("batch_id"))
    state = batches.select(
        "batch_id", "locked", F.col("config_json").alias("batch_config"), F.lit(True).alias("has_batch")
    )
    joined = requests.join(state, "batch_id", "left").join(rollback_targets(history), "batch_id", "left")
    has_batch = F.col("has_batch").isNotNull()
    risks = [
        _risk(~has_batch, "batch_not_found"),
        _risk(has_batch & F.col("locked"), "batch_locked"),
        _risk(has_batch & F.col("latest_id").isNull(), "no_history"),
        _risk(has_batch & F.col("latest_id").isNotNull() & F.col("target_id").isNull(), "already_first"),
    ]
    new_version = F.col("latest_config_version") + 1
    possible = has_batch & F.col("target_id").isNotNull()
    return _with_verdict(joined, risks).withColumns({
        "new_version": F.when(possible, new_version),
        "old_json": F.col("batch_config"),
        "new_json": F.when(possible, with_version(F.col("target_config_json"), new_version)),
        **{c: F.col(f"target_{c}") for c in ("scheme_id", "scheme_name", "source_scheme_id")},
    })


def apply_rollback(requests: DataFrame, batches: DataFrame, history: DataFrame) -> DataFrame:
    """History rows of the rollbacks that may go ahead: the previous configuration under
    the next version, linked to the entry it undoes."""
    return _rolled_back(rollback_precheck(requests, batches, history))


def _rolled_back(checked: DataFrame) -> DataFrame:
    return checked.where("can_proceed").select(
        "batch_id", "scheme_id", "scheme_name", "source_scheme_id",
        F.col("new_version").alias("config_version"),
        F.col("new_json").alias("config_json"),
        F.lit("rollback").alias("action"),
        F.col("latest_id").alias("rolled_back_from_id"),
    )


def roll_back(requests: DataFrame, batches: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """Rows to append when batches are rolled back: ``config_history``, ``audit_log`` (every
    request: success, blocked by a lock, else failed) and ``batches`` (the new state of each
    changed batch). Several requests for one batch count as one."""
    if "request_id" not in requests.columns:
        requests = requests.withColumn("request_id", F.col("batch_id"))
    once = requests.groupBy("batch_id").agg(F.min("request_id").alias("request_id"))
    checked = materialise(rollback_precheck(once, batches, history))  # three tables come from it
    done = _rolled_back(checked)
    locked = F.array_contains("risks.risk", "batch_locked")
    audit = preview(checked).select(
        "request_id", "batch_id",
        *[F.when(F.col("can_proceed"), F.col(c)).alias(c) for c in ("scheme_id", "scheme_name", "source_scheme_id")],
        F.lit("rollback").alias("action"),
        F.when(F.col("can_proceed"), "success").when(locked, "blocked").otherwise("failed").alias("result"),
        F.col("old_json").alias("previous_config_json"),
        *[F.when(F.col("can_proceed"), F.col(c)).alias(n) for c, n in (("new_json", "new_config_json"), ("config_diff", "config_diff"))],
        F.when(locked, "batch_locked").otherwise(F.get("risks.risk", F.lit(0))).alias("error_message"),
    )
    changed = done.select(
        "batch_id", F.col("scheme_id").alias("current_scheme_id"), F.col("scheme_name").alias("current_scheme_name"),
        "config_version", "config_json",
    )
    return {"config_history": done, "audit_log": audit, "batches": changed}


def last_change(batches: DataFrame, audit: DataFrame, schemes: DataFrame, history: DataFrame) -> DataFrame:
    """Newest change of every batch, dry runs left out, with its difference and its scheme and
    rollback details. ``trigger_method``, ``error_message`` and ``source_scheme_id`` of the
    audit row come along where the log has them."""
    kept = [c for c in ("trigger_method", "error_message", "source_scheme_id") if c in audit.columns]
    change = newest(audit.where("action <> 'dry_run'"), "batch_id", "id").select(
        "batch_id", F.col("id").alias("audit_id"), "action", "result", "scheme_id", *kept,
        F.col("previous_config_json").alias("old_json"), F.col("new_config_json").alias("new_json"),
        config_version(F.col("previous_config_json")).alias("old_version"),
        config_version(F.col("new_config_json")).alias("new_version"),
    )
    change = preview(change)
    undone = newest(history, "batch_id", "id").select(
        "batch_id", F.col("rolled_back_from_id").alias("_from"), F.col("scheme_id").alias("_to"),
        F.col("scheme_name").alias("_to_name"),
    )
    rolled = (F.col("action") == "rollback") & F.col("_from").isNotNull()
    return (
        batches.select("batch_id", "batch_name", "locked", "config_version")
        .join(change, "batch_id", "left")
        .join(schemes.select("scheme_id", F.col("name").alias("scheme_name"), "scheme_version"), "scheme_id", "left")
        .join(undone, "batch_id", "left")
        .select(
            "batch_id", "batch_name", "locked", "config_version", "audit_id", "action", "result",
            "scheme_id", "scheme_name", "scheme_version", *kept, "old_version", "new_version", "config_diff",
            F.when(rolled, F.col("_from")).alias("rolled_back_from_id"),
            F.when(rolled, F.col("_to")).alias("rolled_back_to_scheme_id"),
            F.when(rolled, F.col("_to_name")).alias("rolled_back_to_scheme_name"),
        )
    )


def scheme_lineage(schemes: DataFrame) -> DataFrame:
    """Each scheme with the name of its source and its newest imported copy."""
    source = schemes.select(F.col("scheme_id").alias("source_scheme_id"), F.col("name").alias("source_scheme_name"))
    copies = schemes.where(F.col("original_id").isNotNull()).groupBy(
        F.col("original_id").alias("scheme_id")
    ).agg(F.max("scheme_id").alias("newest_copy_id"), F.max_by("name", "scheme_id").alias("newest_copy_name"))
    return (
        schemes.select("scheme_id", "name", "source_scheme_id", "original_id")
        .join(source, "source_scheme_id", "left")
        .join(copies, "scheme_id", "left")
        .select(
            "scheme_id", "name", "source_scheme_id", "source_scheme_name",
            F.coalesce("original_id", "scheme_id").alias("root_id"),
            "newest_copy_id", "newest_copy_name",
        )
    )
