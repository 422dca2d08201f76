"""Bulk import of tickets, under the policies reject and rename.

The inputs count as arriving one after the other in order of ``seq``. An input is in conflict with
a ticket that is there by then: one of the same title, else one of the same source. A part of the
source that the input leaves open (NULL) matches anything, so a ticket of batch 1 and run 2 stands in
the way of inputs from that batch and run, from that batch, and from that run.

Every ticket *holds* the keys it blocks (its title and up to three source keys) and every input *asks*
for two at most. With ``reject`` an accepted input blocks later ones and a rejected one does not, so
decisions depend on each other along both kinds of keys. They are made in rounds: an input is out as
soon as a key it asks for is held by an earlier accepted one, and in as soon as no earlier input that
is undecided holds one. Each round decides the first open input of every key at least, for all keys
at once; with ``rename`` every input is stored, so nothing depends on a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.merge import renamed
from batchgauge.operators.slicing import ROWS_PER_SLICE, with_neighbours, with_numbers
from batchgauge.session import materialise

# The policies, and the names of conflicts, notes and log entries.
POLICIES = ("reject", "rename")
TITLE, SOURCE = "title_exists", "source_exists"
NOTE_COMMENT, NOTE_ASSIGN, NOTE_STATUS = "comment", "assign", "status_change"
AUDIT_CREATE, AUDIT_IMPORT = "ticket_create", "ticket_import"

_KEY = ["kind", "first", "second"]


def _key(kind: str, first: Column | None = None, second: Column | None = None) -> Column:
    parts = [F.lit("") if part is None else part.cast("string") for part in (first, second)]
    return F.struct(F.lit(kind).alias("kind"), parts[0].alias("first"), parts[1].alias("second"))


def _source_keys() -> tuple[Column, Column, Column]:
    """Keys by batch and run, by batch, and by run; NULL where a part is open."""
    batch, run = F.col("source_batch_id"), F.col("source_run_id")
    return (
        F.when(batch.isNotNull() & run.isNotNull(), _key("both", batch, run)),
        F.when(batch.isNotNull(), _key("batch", batch)),
        F.when(run.isNotNull(), _key("run", None, run)),
    )


def _held(tickets: DataFrame, *kept: str) -> DataFrame:
    """One row for every key a ticket blocks."""
    keys = F.array_compact(F.array(_key("title", F.col("title")), *_source_keys()))
    return tickets.select(*kept, F.explode(keys).alias("key")).select(*kept, "key.*")


def _asked(inputs: DataFrame, *kept: str) -> DataFrame:
    """One row for every key an input asks for: its title, and its source as far as it is stated."""
    keys = F.array_compact(F.array(_key("title", F.col("title")), F.coalesce(*_source_keys())))
    return inputs.select(*kept, F.explode(keys).alias("key")).select(*kept, "key.*")


def _accepted(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """``seq`` of the inputs that are stored when conflicts are rejected. ``stored``: keys of tickets.

    Keys that accepted inputs took are kept as long as an open input asks for them, so a round costs
    what is open in it and not what was decided before.
    """
    blocked = _asked(inputs, "seq").join(stored, _KEY, "left_semi").select("seq").distinct()
    live, taken = materialise(inputs.join(blocked, "seq", "left_anti")), None
    accepted, rounds = live.select("seq").limit(0), 0
    while not live.isEmpty():
        first = _held(live, "seq").groupBy(*_KEY).agg(F.min("seq").alias("open"))
        asking = _asked(live, "seq").join(first, _KEY)
        if taken is None:
            asking = asking.withColumn("taken", F.lit(None).cast("bigint"))
        else:
            asking = asking.join(taken, _KEY, "left")
        judged = materialise(asking.groupBy("seq").agg(
            F.bool_or(F.coalesce(F.col("taken") < F.col("seq"), F.lit(False))).alias("out"),
            F.bool_and(F.col("open") == F.col("seq")).alias("next")))
        entering = judged.where("next AND NOT out").select("seq")
        rounds += 1
        accepted = accepted.unionByName(entering)
        if rounds % 16 == 0:  # keeps the plan short
            accepted = materialise(accepted)
        still = materialise(live.join(judged.where("NOT next AND NOT out").select("seq"), "seq", "left_semi"))
        new = _held(live.join(entering, "seq", "left_semi"), "seq").withColumnRenamed("seq", "taken")
        known = new if taken is None else taken.unionByName(new.select(*taken.columns))
        wanted = _asked(still, "seq").select(*_KEY).distinct()
        taken = materialise(known.join(wanted, _KEY, "left_semi").groupBy(*_KEY).agg(F.min("taken").alias("taken")))
        live = still
    return accepted


def _titles(inputs: DataFrame, tickets: DataFrame, stored: DataFrame, rows_per_slice: int) -> DataFrame:
    """Action and title of every input when conflicts are renamed: ``seq, action, final_title``."""
    held = _held(inputs, "seq").where("kind <> 'title'").groupBy(*_KEY).agg(F.min("seq").alias("held"))
    sources = _asked(inputs, "seq").where("kind <> 'title'")
    clash = sources.join(held, _KEY).join(stored, _KEY, "left").where("held < seq OR stored_id IS NOT NULL").select("seq")
    marked = inputs.join(clash.withColumn("clash", F.lit(True)), "seq", "left").withColumn("clash", F.col("clash").isNotNull())
    names = tickets.groupBy("title").agg(F.max("ticket_id").alias("target_id"))
    owners = marked.where("NOT clash").groupBy("title").agg(F.min("seq").alias("owner")).join(names, "title", "left_anti")
    judged = marked.join(owners, "title", "left").select(
        "seq", F.col("title").alias("name"), F.lit(None).cast("bigint").alias("target_id"),
        *(["new_name"] if "new_name" in inputs.columns else []),
        (~F.coalesce(F.col("owner") == F.col("seq"), F.lit(False))).alias("_conflict"))
    return renamed(
        names.withColumnRenamed("title", "name"), owners.select(F.col("title").alias("name")), materialise(judged), rows_per_slice,
    ).select("seq", "action", F.col("final_name").alias("final_title"))


def import_decisions(
    tickets: DataFrame, incoming: DataFrame, policy: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One row per input: ``seq, title, action, conflict_type, existing_id, final_title, ticket_id``.

    ``tickets``: ``ticket_id, title, source_batch_id, source_run_id``; ``incoming``: ``seq, title,
    source_batch_id, source_run_id`` and, for renaming, optionally ``new_title``. Actions are insert,
    reject and rename. ``existing_id`` is the ticket in the way: that of the title, else the newest of
    the source, whether it was there before or came as an earlier input. Stored inputs get new ids after
    the highest one in order of ``seq``. Inputs without a title are rejected as ``title_missing``.
    Titles that inputs keep are reserved before any title is made up.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    optional = [F.col("new_title").alias("new_name")] if "new_title" in incoming.columns and policy == "rename" else []
    rows = incoming.select("seq", "title", "source_batch_id", "source_run_id", *optional)
    named = F.coalesce(F.col("title") != "", F.lit(False))
    inputs, untitled = materialise(rows.where(named)), rows.where(~named)
    stored = materialise(_held(tickets, "ticket_id").groupBy(*_KEY).agg(F.max("ticket_id").alias("stored_id")))
    if policy == "reject":
        decided = inputs.join(_accepted(inputs, stored).withColumn("in", F.lit(True)), "seq", "left").select(
            "seq", F.when(F.col("in"), "insert").otherwise("reject").alias("action"), F.when(F.col("in"), F.col("title")).alias("final_title"))
    else:
        decided = _titles(inputs, tickets, stored, rows_per_slice)
    top = tickets.agg(F.coalesce(F.max("ticket_id"), F.lit(0))).first()[0]
    ids = with_numbers(decided.where("final_title IS NOT NULL"), "seq", "seq").select("seq", (F.col("pos") + top).alias("ticket_id"))
    placed = materialise(inputs.join(decided, "seq").join(ids, "seq", "left"))

    # which ticket was in the way: the last one before the input that holds a key it asks for
    asking = _asked(placed.where("action <> 'insert'"), "seq").withColumns({"ticket_id": F.lit(None).cast("bigint"), "tie": F.lit(0)})
    entered = placed.where("final_title IS NOT NULL").withColumn("title", F.col("final_title"))
    holding = _held(entered, "seq", "ticket_id").join(asking.select(*_KEY).distinct(), _KEY, "left_semi").withColumn("tie", F.lit(1))
    met = with_neighbours(asking.unionByName(holding), _KEY, "seq", "tie", "ticket_id", rows_per_slice)
    hits = met.where("tie = 0").join(stored, _KEY, "left").select(
        "seq", (F.col("kind") == "title").alias("by_title"), F.coalesce("prev_value", "stored_id").alias("hit"))
    hits = hits.groupBy("seq").agg(
        F.max(F.when(F.col("by_title"), F.col("hit"))).alias("title_hit"), F.max(F.when(~F.col("by_title"), F.col("hit"))).alias("source_hit"))
    nothing = F.lit(None).cast("bigint")
    return placed.join(hits, "seq", "left").select(
        "seq", "title", "action",
        F.when(F.col("title_hit").isNotNull(), TITLE).when(F.col("source_hit").isNotNull(), SOURCE).alias("conflict_type"),
        F.coalesce("title_hit", "source_hit").alias("existing_id"), "final_title", "ticket_id",
    ).unionByName(untitled.select(
        "seq", "title", F.lit("reject").alias("action"), F.lit("title_missing").alias("conflict_type"), nothing.alias("existing_id"),
        F.lit(None).cast("string").alias("final_title"), nothing.alias("ticket_id")))


_DOCUMENT = {
    "trigger_rule": "string", "status": "string", "assignee": "string", "resolution": "string",
    "original_ticket_id": "bigint", "imported_from": "string",
}


def import_tickets(
    tickets: DataFrame, incoming: DataFrame, notes: DataFrame, policy: str, rows_per_slice: int = ROWS_PER_SLICE
) -> dict[str, DataFrame]:
    """Rows to append when ticket documents are imported: ``tickets``, ``ticket_notes``, ``audit_log``,
    and the ``decisions`` behind them.

    ``incoming``: documents as ``sources.documents.read_tickets`` gives them, with ``seq``; ``notes``:
    their timeline ``seq, place, author, note_type, content``. A stored ticket keeps status, assignee,
    resolution and origin of its document; its timeline begins with its creation. The log has an entry for
    every input, and one more for every ticket that is made.
    """
    given = [F.col(c) if c in incoming.columns else F.lit(None).cast(t).alias(c) for c, t in _DOCUMENT.items()]
    decisions = materialise(import_decisions(tickets, incoming, policy, rows_per_slice))
    full = materialise(decisions.join(incoming.select("seq", "source_batch_id", "source_run_id", *given), "seq"))
    assignee = F.nullif(F.col("assignee"), F.lit(""))
    entered = full.where("ticket_id IS NOT NULL").withColumn("assignee", assignee)
    new = entered.select(
        "ticket_id", F.col("final_title").alias("title"), "source_batch_id", "source_run_id", "trigger_rule",
        F.coalesce("status", F.when(F.col("assignee").isNotNull(), "assigned").otherwise("open")).alias("status"),
        "assignee", "resolution", "original_ticket_id", "imported_from")
    made = entered.select(
        "ticket_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("author"),
        F.when(F.col("assignee").isNotNull(), NOTE_ASSIGN).otherwise(NOTE_STATUS).alias("note_type"),
        F.when(F.col("assignee").isNotNull(), F.concat(F.lit("ticket created and assigned to "), "assignee"))
        .otherwise("ticket created").alias("content"))
    told = notes.join(entered.select("seq", "ticket_id"), "seq").select(
        "ticket_id", (F.col("place") + 1).cast("bigint").alias("place"), "author",
        F.coalesce("note_type", F.lit(NOTE_COMMENT)).alias("note_type"), "content")

    def log(rows: DataFrame, action: str, **columns: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        details = {c: none for c in ("conflict_type", "conflict_action", "original_title", "final_title", "error_message")} | columns
        return rows.select(
            "seq", F.lit(action).alias("action"), F.lit("import").alias("trigger_method"),
            F.when(F.col("ticket_id").isNotNull(), "success").otherwise("blocked").alias("result"),
            "ticket_id", F.coalesce("final_title", "title").alias("ticket_title"), "existing_id", "source_batch_id", "source_run_id",
            "assignee", "original_ticket_id", "imported_from", *[v.alias(c) for c, v in details.items()])

    stored = F.col("ticket_id").isNotNull()
    audit = log(entered, AUDIT_CREATE).unionByName(log(
        full, AUDIT_IMPORT, conflict_type=F.col("conflict_type"),
        conflict_action=F.when(F.col("action") != "insert", F.col("action")), original_title=F.col("title"),
        final_title=F.col("final_title"), error_message=F.when(~stored, F.col("conflict_type"))))
    return {"decisions": decisions, "tickets": new, "ticket_notes": made.unionByName(told), "audit_log": audit}
