"""Bulk import into a table with a unique name, under a conflict policy.

The inputs count as arriving one after the other in order of ``seq``. A name is in
conflict when the table has it or an earlier input brought it. Names that inputs bring
themselves are reserved before any name is made up for a renamed input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.slicing import ROWS_PER_SLICE, largest_group, with_numbers, with_positions
from batchgauge.session import materialise

# The policies, and the suffix given to renamed inputs.
POLICIES = ("reject", "skip", "overwrite", "rename")
SUFFIX = "_imported"
NUMBERED = rf"^(.*){SUFFIX}(?:_([1-9][0-9]*))?$"


def merge_decisions(
    existing: DataFrame,
    incoming: DataFrame,
    policy: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per input: ``seq, name, action, final_name, target_id``.

    ``existing``: ``id, name``; ``incoming``: ``seq, name`` and, for renaming,
    optionally ``new_name``. Actions are insert, reject, skip, overwrite, rename;
    ``final_name`` is NULL for inputs that are not stored.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    stored = existing.select("name", F.col("id").alias("target_id"))
    names = incoming.groupBy("name").agg(F.min("seq").alias("_first")).join(stored, "name", "left")
    judged = incoming.join(names, "name").withColumn(
        "_conflict", F.col("target_id").isNotNull() | (F.col("seq") != F.col("_first"))
    )
    if policy == "rename":
        own = names.where(F.col("target_id").isNull()).select("name")
        return renamed(existing, own, judged.drop("_first"), rows_per_slice)
    action = F.when(F.col("_conflict"), policy).otherwise("insert")
    kept = ~F.col("_conflict") if policy != "overwrite" else F.lit(True)
    return judged.select(
        "seq", "name", action.alias("action"),
        F.when(kept, F.col("name")).alias("final_name"), "target_id",
    )


def renamed(existing: DataFrame, own: DataFrame, judged: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Names of inputs (``seq, name, target_id, _conflict``, optionally ``new_name``): those in conflict
    get their new name if it is free, else the first free suffix. ``own``: names that inputs keep."""
    taken = existing.select("name").unionByName(own)
    clashes = materialise(judged.where("_conflict").drop("_conflict"))
    unclear = clashes
    explicit = None
    if "new_name" in judged.columns:
        free = clashes.where(F.col("new_name").isNotNull()).join(
            taken.withColumnRenamed("name", "new_name"), "new_name", "left_anti"
        )
        explicit = free.groupBy("new_name").agg(F.min("seq").alias("seq"))
        unclear = clashes.join(explicit.select("seq"), "seq", "left_anti")
        taken = taken.unionByName(explicit.select(F.col("new_name").alias("name")))
    made_up = _first_free_names(taken, unclear.select("seq", "name"), rows_per_slice)
    plain = judged.where(~F.col("_conflict")).select(
        "seq", "name", F.lit("insert").alias("action"), F.col("name").alias("final_name"), "target_id"
    )
    generated = unclear.join(made_up, ["seq", "name"]).select(
        "seq", "name", F.lit("rename").alias("action"), "final_name", "target_id"
    )
    result = plain.unionByName(generated)
    if explicit is not None:
        given = clashes.join(explicit.withColumnRenamed("new_name", "final_name"), "seq")
        result = result.unionByName(given.select(
            "seq", "name", F.lit("rename").alias("action"), "final_name", "target_id"
        ))
    return result


def _first_free_names(taken: DataFrame, inputs: DataFrame, rows_per_slice: int) -> DataFrame:
    """Give the inputs of each name the free suffixes in turn: ``x_imported``,
    ``x_imported_1``, ``x_imported_2``, ...

    Suffix numbers are 0, 1, 2, ... The r-th input (from 0) of a name gets the number
    with exactly r free numbers before it. The j-th taken number t (from 0) has t - j free
    ones before it. Sorting both kinds of rows by that count, taken first, puts the input
    at the place that equals its number: r inputs and all smaller taken numbers precede.
    """
    match = F.regexp_extract("name", NUMBERED, 2)
    numbers = taken.where(F.col("name").rlike(NUMBERED)).select(
        F.regexp_extract("name", NUMBERED, 1).alias("base"),
        F.when(match == "", 0).otherwise(match.try_cast("bigint")).cast("bigint").alias("t"),
    ).where(F.col("t").isNotNull())
    inputs = inputs.withColumnRenamed("name", "base")
    wanted = inputs.select("base").distinct()
    numbers = materialise(numbers.join(wanted, "base", "left_semi").distinct())
    # one measurement bounds the groups of all three orderings
    largest = largest_group(numbers.select("base").unionByName(inputs.select("base")), ["base"])
    sizes = {"rows_per_slice": rows_per_slice, "largest": largest}
    ranked = with_positions(numbers, ["base"], "t", "t", "j", **sizes).select(
        "base", (F.col("t") - F.col("j") + 1).alias("free_before"),
        F.lit(-1).cast("bigint").alias("kind"), F.lit(None).cast("bigint").alias("seq"),
    )
    placed = with_positions(inputs, ["base"], "seq", "seq", "r", **sizes).select(
        "base", (F.col("r") - 1).alias("free_before"), F.lit(0).cast("bigint").alias("kind"), "seq"
    )
    merged = with_positions(
        ranked.unionByName(placed), ["base"], "free_before", "kind", "place", **sizes
    )
    number = F.col("place") - 1
    return merged.where("kind = 0").select(
        "seq", F.col("base").alias("name"),
        F.concat(F.col("base"), F.lit(SUFFIX), F.when(number == 0, "").otherwise(
            F.concat(F.lit("_"), number.cast("string"))
        )).alias("final_name"),
    )


def scheme_import_decisions(
    existing: DataFrame, incoming: DataFrame, policy: str, strict: bool = True
) -> DataFrame:
    """Decisions for scheme files (``seq, name, compatible, missing``).

    Strict checking keeps files of another major version or with missing sections out
    under every policy; lenient checking lets overwrite and rename store them.
    """
    broken = ~F.col("compatible") | (F.size("missing") > 0)
    out = F.lit(True) if strict else F.lit(policy in ("reject", "skip"))
    held = incoming.where(broken & out)
    reason = F.when(~F.col("compatible"), "version_mismatch").otherwise("missing_fields")
    decided = merge_decisions(existing, incoming.where(~(broken & out)), policy).withColumn(
        "reason", F.when(F.col("action").isin("reject", "skip"), "name_exists")
    )
    return decided.unionByName(held.select(
        "seq", "name", F.lit("skip" if policy == "skip" else "reject").alias("action"),
        F.lit(None).cast("string").alias("final_name"), F.lit(None).cast("bigint").alias("target_id"),
        reason.alias("reason"),
    ))


def merged_table(
    existing: DataFrame,
    incoming: DataFrame,
    decisions: DataFrame,
    payload: list[str],
) -> DataFrame:
    """The table after the import: ``id, name``, payload, and provenance.

    Overwritten rows keep their id and take the payload of the last input; stored inputs
    get new ids after the highest one. ``original_id`` stays that of the first ancestor:
    an input that already names one passes it on.
    """
    stored = decisions.where(F.col("final_name").isNotNull()).join(
        incoming.select("seq", *payload, "original_id"), "seq"
    )
    final = stored.groupBy("final_name").agg(
        F.max_by(F.struct(*payload), "seq").alias("_p"),
        F.min("seq").alias("seq"),
        F.max("target_id").alias("_hit"),
        F.max(F.col("action") == "overwrite").alias("_over"),
        F.min_by("name", "seq").alias("original_name"),
        F.min_by("original_id", "seq").alias("original_id"),
    )
    replaced = F.col("_over") & F.col("_hit").isNotNull()
    changed = final.where(replaced).select("final_name", F.col("_p").alias("_new"))
    kept = existing.join(changed, existing["name"] == changed["final_name"], "left").select(
        "id", "name",
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.lit(None).cast("string").alias("original_name"), "original_id",
    )
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = with_numbers(final.where(~replaced), "seq", "seq").select(
        (F.col("pos") + top).alias("id"), F.col("final_name").alias("name"),
        *[F.col(f"_p.{c}").alias(c) for c in payload], "original_name", "original_id",
    )
    return kept.unionByName(fresh)
