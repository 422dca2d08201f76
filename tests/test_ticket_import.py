"""Ticket import against a replay of the inputs one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from batchgauge.operators import merge, slicing, ticket_import
from batchgauge.session import materialise
from batchgauge.sources import documents

TICKETS = "ticket_id BIGINT, title STRING, source_batch_id BIGINT, source_run_id BIGINT"
INPUTS = "seq BIGINT, title STRING, source_batch_id BIGINT, source_run_id BIGINT, new_title STRING"


def replay(tickets, inputs, policy):
    """``tickets`` and ``inputs`` as tuples; the same rows as ``import_decisions`` gives."""
    held, top = list(tickets), max((t[0] for t in tickets), default=0)
    inputs = sorted(inputs)

    def in_the_way(title, batch, run):
        by_title = [t[0] for t in held if t[1] == title]
        if by_title:
            return "title_exists", max(by_title)
        if batch is None and run is None:
            return None, None
        by_source = [t[0] for t in held if batch in (None, t[2]) and run in (None, t[3])]
        return ("source_exists", max(by_source)) if by_source else (None, None)

    # titles that inputs keep are reserved: with rename, sources alone decide which inputs these are
    kept, sources, names = {}, [(t[2], t[3]) for t in tickets], {t[1] for t in tickets}
    for seq, title, batch, run, _ in inputs:
        if not title:
            continue
        clash = (batch is not None or run is not None) and any(batch in (None, b) and run in (None, r) for b, r in sources)
        if not clash and title not in names:
            kept.setdefault(title, seq)
        sources.append((batch, run))
    reserved = names | set(kept)
    explicit = set()
    if policy == "rename":  # the first input in conflict that asks for a free new title gets it
        for seq, title, *_, new in inputs:
            if title and new is not None and kept.get(title) != seq and new not in reserved and new not in explicit:
                explicit.add(new)
    given, out, made = set(), [], set()
    for seq, title, batch, run, new in inputs:
        if not title:
            out.append((seq, title, "reject", "title_missing", None, None, None))
            continue
        conflict, existing = in_the_way(title, batch, run)
        if conflict is None:
            action, final = "insert", title
        elif policy == "reject":
            out.append((seq, title, "reject", conflict, existing, None, None))
            continue
        elif new is not None and new in explicit and new not in given:
            action, final = "rename", new
            given.add(new)
        else:
            action, n = "rename", 0
            final = f"{title}_imported"
            while final in reserved | explicit | made:
                n += 1
                final = f"{title}_imported_{n}"
            made.add(final)
        top += 1
        held.append((top, final, batch, run))
        out.append((seq, title, action, conflict, existing, final, top))
    return sorted(out, key=repr)


def decided(spark, tickets, inputs, policy, **more):
    found = ticket_import.import_decisions(
        spark.createDataFrame(tickets, TICKETS), spark.createDataFrame(inputs, INPUTS).repartition(3), policy, **more)
    return sorted(map(tuple, found.collect()), key=repr)


def random_case(seed, titles, batches, runs, n):
    pick = random.Random(seed)

    def maybe(value):
        return None if pick.random() < 0.3 else value

    names = [f"t{i}" for i in range(titles)]
    tickets = [(i + 1, f"{names[i]}", maybe(pick.randrange(batches)), maybe(pick.randrange(runs))) for i in range(3)]
    tickets.append((9, "t5_imported", 0, None))
    inputs = []
    for seq in pick.sample(range(10 * n), n):
        title = pick.choice([*names, "t5_imported", "t6_imported_1", "", None] if pick.random() < 0.2 else names)
        new = pick.choice(["fresh", "t7", f"t{pick.randrange(titles)}_imported", f"n{pick.randrange(9)}"]) if pick.random() < 0.3 else None
        inputs.append((seq, title, maybe(pick.randrange(batches)), maybe(pick.randrange(runs)), new))
    return tickets, inputs


@pytest.mark.parametrize("policy", ticket_import.POLICIES)
@pytest.mark.parametrize("seed, titles, batches, runs, n", [(1, 12, 4, 3, 60), (2, 60, 30, 20, 150), (3, 200, 60, 9, 120), (4, 9, 90, 90, 90)])
def test_decisions_equal_a_replay(spark, policy, seed, titles, batches, runs, n):
    tickets, inputs = random_case(seed, titles, batches, runs, n)
    assert decided(spark, tickets, inputs, policy) == replay(tickets, inputs, policy)
    if seed == 2:  # look-ups cut into slices
        assert decided(spark, tickets, inputs, policy, rows_per_slice=7) == replay(tickets, inputs, policy)


def test_a_chain_over_both_kinds_of_keys(spark):
    """Each input is blocked by the one before it, by title and by source in turn: every second one is in."""
    inputs = [(i, f"t{(i + 1) // 2}", None, i // 2, None) for i in range(24)]
    found = decided(spark, [], inputs, "reject")
    assert found == replay([], inputs, "reject")
    assert sum(r[2] == "insert" for r in found) == 12


def test_open_parts_of_the_source_match_anything(spark):
    tickets = [(5, "a", 1, 2), (6, "b", 1, None), (7, "c", None, 2)]
    inputs = [(1, "x", 1, None, None), (2, "y", None, 2, None), (3, "z", 1, 2, None), (4, "u", 1, 3, None), (5, "v", None, None, None), (6, "a", 1, 3, None)]
    found = {r[0]: r[2:5] for r in decided(spark, tickets, inputs, "reject")}
    assert found == {
        1: ("reject", "source_exists", 6), 2: ("reject", "source_exists", 7), 3: ("reject", "source_exists", 5),
        4: ("insert", None, None), 5: ("insert", None, None), 6: ("reject", "title_exists", 5)}


def test_unknown_policies_and_empty_tables(spark):
    with pytest.raises(ValueError):
        decided(spark, [], [], "overwrite")
    for policy in ticket_import.POLICIES:
        assert decided(spark, [], [], policy) == []
        assert decided(spark, [], [(1, "a", None, None, None)], policy) == [(1, "a", "insert", None, None, "a", 1)]


def test_import_of_documents_keeps_the_root(spark, tmp_path):
    """Exported, imported, exported and imported again: status, notes and the first origin stay."""
    from batchgauge.operators import tickets as t

    table = spark.createDataFrame([(4, "check pump", 1, 10, "drift", "resolved", "ann", "fixed", None)],
        TICKETS + ", trigger_rule STRING, status STRING, assignee STRING, resolution STRING, original_ticket_id BIGINT")
    notes = spark.createDataFrame([(4, 1, "ann", "comment", "looks off"), (4, 2, "bob", None, "replaced")],
        "ticket_id BIGINT, note_id BIGINT, author STRING, note_type STRING, content STRING")
    for generation in range(3):
        folder = str(tmp_path / str(generation))
        t.ticket_documents(table, notes).write.json(folder)
        parts = documents.read_ticket_parts(spark, folder, lines=True).withColumn("seq", F.lit(1).cast("bigint"))
        timeline = documents.ticket_notes(parts, "title").withColumns({"place": F.col("seq"), "seq": F.lit(1).cast("bigint")})
        made = ticket_import.import_tickets(table.limit(0), parts, timeline, "reject")
        table, notes = made["tickets"], made["ticket_notes"].withColumn("note_id", F.col("place"))
        row = table.first()
        assert (row.title, row.status, row.assignee, row.resolution, row.original_ticket_id) == ("check pump", "resolved", "ann", "fixed", 4)
        assert row.imported_from.startswith("file:") and notes.count() == 3 + generation
        assert [r.content for r in notes.orderBy("place").collect()][-2:] == ["looks off", "replaced"]


def test_tables_of_an_import(spark):
    tickets = spark.createDataFrame([(3, "a", 1, None)], TICKETS)
    inputs = spark.createDataFrame(
        [(1, "a", 2, None, "x", None), (2, "b", 1, None, "", None), (3, "c", None, None, None, "reopened")],
        "seq BIGINT, title STRING, source_batch_id BIGINT, source_run_id BIGINT, assignee STRING, status STRING")
    notes = spark.createDataFrame([(1, 0, "n", None, "first")], "seq BIGINT, place BIGINT, author STRING, note_type STRING, content STRING")
    made = ticket_import.import_tickets(tickets, inputs, notes, "rename")
    assert sorted((r.ticket_id, r.title, r.status, r.assignee) for r in made["tickets"].collect()) == [
        (4, "a_imported", "assigned", "x"), (5, "b_imported", "open", None), (6, "c", "reopened", None)]
    assert sorted((r.ticket_id, r.place, r.note_type, r.content) for r in made["ticket_notes"].collect()) == [
        (4, 0, "assign", "ticket created and assigned to x"), (4, 1, "comment", "first"),
        (5, 0, "status_change", "ticket created"), (6, 0, "status_change", "ticket created")]
    assert sorted((r.seq, r.action, r.result, r.conflict_type, r.conflict_action, r.existing_id) for r in made["audit_log"].collect() if r.seq < 3) == [
        (1, "ticket_create", "success", None, None, 3), (1, "ticket_import", "success", "title_exists", "rename", 3),
        (2, "ticket_create", "success", None, None, 3), (2, "ticket_import", "success", "source_exists", "rename", 3)]
    refused = ticket_import.import_tickets(tickets, inputs, notes, "reject")
    assert refused["ticket_notes"].count() == 1 and refused["tickets"].count() == 1
    assert sorted((r.seq, r.result, r.error_message) for r in refused["audit_log"].collect()) == [
        (1, "blocked", "title_exists"), (2, "blocked", "source_exists"), (3, "success", None), (3, "success", None)]


# --- dense numbers ------------------------------------------------------------------


@pytest.mark.parametrize("values", [range(100), [3] * 50 + [4] * 50, [0] * 99 + [10**15], [5], [], [None, 2, None, 1]])
def test_numbers_over_all_rows_without_one_group(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v BIGINT, i BIGINT").repartition(3)
    made = slicing.with_numbers(df, "v", "i", "n", rows_per_range=7)
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0, i))
    assert {r.i: r.n for r in made.collect()} == {i: n + 1 for n, i in enumerate(order)}
    if len(values) == 100:
        windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in line]
        assert windows and all("_slice0" in line for line in windows)


def test_new_ids_follow_the_order_of_inputs(spark):
    existing = spark.createDataFrame([(7, "a", "old", None)], "id BIGINT, name STRING, config STRING, original_id BIGINT")
    incoming = spark.createDataFrame([(i, f"n{i % 40}", f"c{i}", None) for i in range(300)], "seq BIGINT, name STRING, config STRING, original_id BIGINT")
    merged = merge.merged_table(existing, incoming, merge.merge_decisions(existing, incoming, "skip"), ["config"])
    assert sorted((r.id, r.name) for r in merged.collect()) == [(7, "a"), *((8 + i, f"n{i}") for i in range(40))]


def test_rounds_keep_the_keys_that_are_asked_for(spark, monkeypatch):
    """Keys of accepted inputs that no open input asks for are not carried from round to round."""
    sizes = []

    def recorded(df):
        stored = materialise(df)
        if "taken" in df.columns:
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(ticket_import, "materialise", recorded)
    rows = [(i, f"t{i}", i, i, None) for i in range(60)] + [(100, "x", 500, None, None), (101, "x", 501, None, None), (102, "y", 501, None, None)]
    found = ticket_import.import_decisions(spark.createDataFrame([], TICKETS), spark.createDataFrame(rows, INPUTS), "reject")
    assert [r.seq for r in found.where("action = 'reject'").collect()] == [101]
    assert len(sizes) > 1 and max(sizes) <= 4
