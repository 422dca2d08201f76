"""Review tickets: state from the event log, conflicts, raising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.slicing import ROWS_PER_SLICE, with_neighbours, with_positions


def judged_events(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Events (``ticket_id, seq, action, actor, payload``) with ``accepted``.

    assign and resolve need an unresolved ticket, reopen a resolved one; create and
    comment always pass. A resolve event leaves the ticket resolved and a reopen event
    leaves it unresolved whether or not it was accepted, so the state an event meets
    follows from the nearest earlier resolve or reopen. That is a look-back over an
    ordered log, which a log of any length can be cut into slices for.
    """
    turns = events.withColumn("turn", F.when(F.col("action").isin("resolve", "reopen"), F.col("action")))
    met = with_neighbours(turns, ["ticket_id"], "seq", "seq", "turn", rows_per_slice)
    resolved = F.coalesce(F.col("prev_value") == "resolve", F.lit(False))
    accepted = (
        F.when(F.col("action").isin("assign", "resolve"), ~resolved)
        .when(F.col("action") == "reopen", resolved)
        .otherwise(F.lit(True))
    )
    return met.select(*events.columns, resolved.alias("was_resolved"), accepted.alias("accepted"))


def ticket_state(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Current status, assignee and resolution of every ticket.

    ``payload`` is the assignee of create and assign events and the resolution of resolve events;
    a resolve event may name an assignee as well, in the optional column ``assignee``.
    """
    named = F.col("assignee") if "assignee" in events.columns else F.lit(None).cast("string")
    events = events.withColumn("assignee", named)
    judged = judged_events(events, rows_per_slice)
    action = F.col("action")
    status = (
        F.when(action == "create", F.when(F.col("payload").isNotNull(), "assigned").otherwise("open"))
        .when(action == "assign", "assigned")
        .when(action == "resolve", "resolved")
        .when(action == "reopen", "reopened")
    )
    assignee = F.when(action.isin("create", "assign"), F.col("payload")).when(action == "resolve", F.col("assignee"))
    resolution = F.when(action == "resolve", F.col("payload"))
    ok = judged.withColumns({
        "new_status": F.when(F.col("accepted"), status),
        "new_assignee": F.when(F.col("accepted"), assignee),
        "new_resolution": F.when(F.col("accepted"), resolution),
    })

    def newest_known(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))

    return ok.groupBy("ticket_id").agg(
        F.coalesce(newest_known("new_status"), F.lit("open")).alias("status"),
        newest_known("new_assignee").alias("assignee"),
        newest_known("new_resolution").alias("resolution"),
        F.count_if("accepted").alias("accepted_events"),
        F.count_if(~F.col("accepted")).alias("rejected_events"),
    )


def illegal_events(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Events the state machine refuses."""
    reason = F.when(F.col("action") == "reopen", "not_resolved").otherwise("already_resolved")
    return (
        judged_events(events, rows_per_slice)
        .where(~F.col("accepted"))
        .select("ticket_id", "seq", "action", reason.alias("reason"))
    )


def ticket_conflicts(incoming: DataFrame, tickets: DataFrame) -> DataFrame:
    """Conflict of each incoming ticket: same title, else same source (newest ticket).

    A source part that is NULL in the input matches anything. Each of the three shapes
    (batch and run, batch only, run only) has its own table of newest tickets with one row
    per key, so every input meets at most one row.
    """
    known = F.col("source_batch_id").isNotNull(), F.col("source_run_id").isNotNull()
    nothing = F.lit(-1).cast("bigint")

    def newest_by(shape: str, with_batch: bool, with_run: bool) -> DataFrame:
        rows = tickets
        if with_batch:
            rows = rows.where(known[0])
        if with_run:
            rows = rows.where(known[1])
        return rows.groupBy(
            F.lit(shape).alias("shape"),
            (F.col("source_batch_id") if with_batch else nothing).alias("k_batch"),
            (F.col("source_run_id") if with_run else nothing).alias("k_run"),
        ).agg(F.max("ticket_id").alias("source_hit"))

    lookup = (
        newest_by("both", True, True)
        .unionByName(newest_by("batch", True, False))
        .unionByName(newest_by("run", False, True))
    )
    shape = F.when(known[0] & known[1], "both").when(known[0], "batch").when(known[1], "run")
    titles = tickets.groupBy("title").agg(F.max("ticket_id").alias("title_hit"))
    return (
        incoming.withColumns({
            "shape": shape,
            "k_batch": F.coalesce("source_batch_id", nothing),
            "k_run": F.coalesce("source_run_id", nothing),
        })
        .join(titles, "title", "left")
        .join(lookup, ["shape", "k_batch", "k_run"], "left")
        .select(
            "seq", "title",
            F.when(F.col("title_hit").isNotNull(), "title_exists")
            .when(F.col("source_hit").isNotNull(), "source_exists")
            .alias("conflict_type"),
            F.coalesce("title_hit", "source_hit").alias("existing_id"),
        )
    )


def raise_tickets(
    verdicts: DataFrame, counts: DataFrame, tickets: DataFrame, max_anomalies: int
) -> DataFrame:
    """Tickets to open: blocked drift checks, and batches with too many anomalies, unless
    the batch already has a ticket of that rule."""
    blocked = verdicts.where("check_status = 'block'").select(
        "batch_id", F.lit("baseline_blocked").alias("trigger_rule")
    )
    flooded = counts.where(F.col("sensor").isNull() & (F.col("anomalies") > max_anomalies)).select(
        "batch_id", F.lit("too_many_anomalies").alias("trigger_rule")
    )
    return (
        blocked.unionByName(flooded)
        .distinct()
        .join(tickets.select("batch_id", "trigger_rule"), ["batch_id", "trigger_rule"], "left_anti")
        .withColumn("title", F.concat_ws(": ", "trigger_rule", "batch_id"))
    )


NOTES_PER_DOCUMENT = 1000
"""Notes in one exchange document; a longer timeline goes on in further parts, which
``sources.documents`` puts together again."""


def ticket_documents(
    tickets: DataFrame, notes: DataFrame, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Tickets as exchange documents with their note timeline, in order.

    The format nests the notes, so a timeline is split into numbered parts of bounded
    length: no row grows with the number of notes of a ticket, and none is left out.
    ``notes_before`` counts the notes in earlier parts. ``created_at`` of notes is optional.
    """
    if "created_at" not in notes.columns:
        notes = notes.withColumn("created_at", F.lit(None).cast("string"))
    placed = with_positions(notes, ["ticket_id"], "note_id", "note_id", "pos", rows_per_slice)
    line = F.struct("note_id", "author", "note_type", "content", F.col("created_at").cast("string").alias("created_at"))
    parts = placed.groupBy(
        "ticket_id", F.floor((F.col("pos") - 1) / NOTES_PER_DOCUMENT).alias("part")
    ).agg(F.array_sort(F.collect_list(line)).alias("notes"))
    none = F.array().cast(parts.schema["notes"].dataType)
    return tickets.join(parts, "ticket_id", "left").withColumns({
        "part": F.coalesce("part", F.lit(0)),
        "notes_before": F.coalesce("part", F.lit(0)) * NOTES_PER_DOCUMENT,
        "notes": F.coalesce("notes", none),
        "original_ticket_id": F.coalesce("original_ticket_id", "ticket_id"),
    })
