"""Comparison, drift, replay, configurations, merging, tickets, listings."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from batchgauge.functions.settings import with_version
from batchgauge.operators.slicing import left_join_known
from batchgauge.operators import anomaly, catalog, compare, configs, drift, impute, merge, metrics, replay, tickets
from batchgauge.plans import bindings
from batchgauge.plans.catalogue import QUERIES
from helpers import rows_of

METRIC = "batch_id STRING, sensor STRING, metric_name STRING, metric_value DOUBLE"


def metric_frame(spark, rows):
    return spark.createDataFrame(rows, METRIC)


def test_matrix(spark):
    found = compare.metric_matrix(metric_frame(spark, [
        ("a", "s", "mean", 10.0), ("b", "s", "mean", 12.0), ("a", "s", "min", 0.0), ("b", "s", "min", 3.0),
        ("a", "s", "max", -4.0), ("b", "s", "max", -5.0), ("a", "t", "mean", 1.0), ("a", "s", "std", 2.0), ("b", "s", "std", 2.0),
    ]))
    by_key = {(r.sensor, r.metric_name): (r.abs_diff, r.rel_diff_pct) for r in found.collect()}
    assert by_key == {
        ("s", "mean"): (2.0, pytest.approx(20.0)), ("s", "min"): (3.0, None), ("s", "max"): (1.0, pytest.approx(20.0)),
        ("t", "mean"): (None, None), ("s", "std"): (0.0, 0.0),
    }
    assert tuple(compare.matrix_summary(found).first()) == (5, 3)
    assert [r.metric_name for r in compare.top_differences(found, 2).collect()] == ["min", "mean"]


def test_matrix_wide_has_a_column_per_batch(spark):
    wide = compare.metric_matrix_wide(metric_frame(spark, [("a", "s", "mean", 1.0), ("b", "s", "mean", 2.0), ("b", "t", "mean", 3.0)]))
    assert wide.columns == ["sensor", "metric_name", "value_a", "value_b", "abs_diff", "rel_diff_pct"]
    assert rows_of(wide, "sensor", "value_a", "value_b", "abs_diff") == [("s", 1.0, 2.0, 1.0), ("t", None, 3.0, None)]


def test_anomaly_counts_keep_zero_batches(spark):
    batches = spark.createDataFrame([("a",), ("b",)], "batch_id STRING")
    marked = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "batch_id STRING, sensor STRING")
    counts = anomaly.anomaly_counts(marked, batches)
    assert rows_of(counts.where("sensor IS NULL"), "batch_id", "anomalies") == [("a", 3), ("b", 0)]
    assert tuple(anomaly.anomaly_range(counts).first()) == (0, 3, 3, 2)
    wide = compare.anomaly_table(counts, batches)
    assert rows_of(wide, "batch_id", "total_anomalies", "anomalies_x", "anomalies_y") == [("a", 3, 2, 1), ("b", 0, 0, 0)]
    none = anomaly.anomaly_counts(marked.limit(0), batches.limit(1))
    assert tuple(anomaly.anomaly_range(none).first()) == (0, 0, None, 0)


def test_drift_levels_are_inclusive(spark):
    base = drift.build_thresholds(metric_frame(spark, [
        ("0", "s", "mean", 100.0), ("0", "s", "min", 0.0), ("0", "s", "max", -10.0), ("0", "s", "range", 0.0), ("0", "s", "gone", 1.0),
    ])).withColumn("baseline_id", F.lit(1))
    bands = {r.metric_name: (r.warn_min, r.block_max) for r in base.collect()}
    assert bands["min"] == (-0.01, 0.1) and bands["max"] == (-10.5, -8.5)
    values = {"ok": 105.0, "w": 114.0, "b": 116.0}
    metrics = metric_frame(spark, [(b, "s", "mean", v) for b, v in values.items()] + [("ok", "s", "min", 0.0), ("w", "s", "range", 0.5), ("w", "s", "max", -10.0)])
    requests = spark.createDataFrame([(1, b) for b in (*values, "nothing")], "baseline_id INT, batch_id STRING")
    checks = drift.drift_check(base, metrics, requests)
    assert rows_of(checks, "batch_id", "metric_name", "status") == [
        ("b", "mean", "block"), ("ok", "mean", "pass"), ("ok", "min", "pass"), ("w", "max", "pass"), ("w", "mean", "warn"), ("w", "range", "block")]
    verdict = drift.drift_verdict(checks, requests)
    assert rows_of(verdict, "batch_id", "check_status", "total_metrics") == [
        ("b", "block", 1), ("nothing", "pass", 0), ("ok", "pass", 2), ("w", "block", 3)]


def test_custom_thresholds_and_name_keying(spark):
    metrics = metric_frame(spark, [("0", "a", "mean", 10.0), ("0", "z", "mean", 20.0)])
    custom = spark.createDataFrame([("a", "mean", 50.0, None)], "sensor STRING, metric_name STRING, warn_pct DOUBLE, block_pct DOUBLE")
    base = drift.build_thresholds(metrics, custom=custom).withColumn("baseline_id", F.lit(1))
    assert rows_of(base, "sensor", "warn_pct", "block_pct") == [("a", 50.0, 15.0), ("z", 5.0, 15.0)]
    target = metric_frame(spark, [("t", "a", "mean", 10.0), ("t", "y", "mean", 30.0)])
    requests = spark.createDataFrame([(1, "t")], "baseline_id INT, batch_id STRING")
    assert rows_of(drift.drift_check_by_name(base, target, requests), "baseline_value", "actual_value", "status") == [(20.0, 30.0, "block")]


def test_replay(spark):
    old = metric_frame(spark, [("b", "s", m, v) for m, v in (("mean", 100.0), ("min", 0.0), ("max", 0.0), ("std", 1.0), ("gone", 1.0))])
    new = metric_frame(spark, [("b", "s", m, v) for m, v in (("mean", 100.9), ("min", 0.0), ("max", 0.5), ("std", 1.1), ("fresh", 1.0))])
    compared = replay.replay_comparison(old, new, 1.0)
    listed = replay.replay_differences(compared)
    assert rows_of(listed, "metric_name", "within_tolerance", "one_sided") == [
        ("fresh", False, True), ("gone", False, True), ("max", False, False), ("mean", True, False), ("std", False, False)]
    assert compared.where("metric_name = 'max'").first().rel_diff_pct == float("inf")
    assert tuple(replay.replay_verdict(compared).first()) == ("b", 6, 5, 4, False)
    same = replay.replay_verdict(replay.replay_comparison(old, old))
    assert tuple(same.first()) == ("b", 5, 0, 0, True)


def test_registration(spark):
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_id BIGINT")
    runs = spark.createDataFrame([(10, 1, "success"), (11, 2, "failed"), (12, 1, "success")], "run_id BIGINT, batch_id BIGINT, run_status STRING")
    taken = spark.createDataFrame([("old",)], "name STRING")
    requests = spark.createDataFrame(
        [(1, "n", 1, None), (2, "n", 1, 10), (3, "x", 2, None), (4, "x", 2, 10), (5, "old", 1, 10), (6, "x", 9, None), (7, "x", 3, None)],
        "request_id BIGINT, name STRING, batch_id BIGINT, run_id BIGINT")
    found = drift.registration_decisions(requests, batches, runs, taken)
    assert rows_of(found, "request_id", "run_id", "reason") == [
        (1, 12, None), (2, 10, "name_exists"), (3, 11, "run_not_successful"), (4, 10, "run_not_of_batch"),
        (5, 10, "name_exists"), (6, None, "batch_not_found"), (7, None, "batch_not_run")]


def diff_of(spark, old, new):
    pairs = spark.createDataFrame([(1, json.dumps(old), json.dumps(new))], "id INT, old_json STRING, new_json STRING")
    return rows_of(configs.config_diff(pairs, ["id"]), "path", "change", "old_value", "new_value")


def test_config_diff(spark):
    old = {"version": 1, "a": {"b": {"c": 1, "d": True}, "gone": "x"}, "same": 5, "flag": 1, "empty": {}}
    new = {"version": 2, "a": {"b": {"c": 1.0, "d": False}}, "same": 5, "flag": True, "more": {"n": None}}
    assert diff_of(spark, old, new) == [
        ("a.b.d", "modified", "true", "false"), ("a.gone", "removed", "x", None),
        ("more.n", "added", None, None), ("version", "modified", "1", "2")]
    assert diff_of(spark, old, old) == []


@pytest.mark.parametrize("text, expected", [
    ('{"version": 3, "cleaning": {"remove_duplicates": true}}', {"version": 9, "cleaning": {"remove_duplicates": True}}),
    ('{"other": 1}', {"version": 9, "other": 1}),
    ('{"cleaning": {"remove_duplicates": true}, "version": 3}', {"version": 9, "cleaning": {"remove_duplicates": True}}),
])
def test_version_is_replaced(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t STRING").select(with_version(F.col("t"), F.lit(9)).alias("v")).first()
    assert json.loads(row.v) == expected


CONFIG = '{"version": %d, "cleaning": {}, "missing_values": {}, "metrics": {}, "anomaly_detection": {"zscore_threshold": %s}}'


def registry(spark):
    batches = spark.createDataFrame(
        [(1, "one", False, 4, CONFIG % (4, "3.0")), (2, "two", True, 1, CONFIG % (1, "3.0")), (3, "three", False, 1, CONFIG % (1, "3.0"))],
        "batch_id BIGINT, batch_name STRING, locked BOOLEAN, config_version BIGINT, config_json STRING")
    schemes = spark.createDataFrame(
        [(1, "base", "1.0", CONFIG % (1, "2.0"), None, None), (2, "other", "2.0", CONFIG % (7, "1.5"), 1, None),
         (3, "broken", "1.0", '{"version": 1}', None, None), (4, "copy", "1.0", CONFIG % (1, "2.0"), None, 1)],
        "scheme_id BIGINT, name STRING, scheme_version STRING, config_json STRING, source_scheme_id BIGINT, original_id BIGINT")
    history = spark.createDataFrame(
        [(5, 3, 1, "base", 11, 2, CONFIG % (2, "2.0"), "apply", None), (4, 3, None, None, None, 1, CONFIG % (1, "3.0"), "baseline", None), (6, 2, 1, "base", 11, 2, CONFIG % (2, "2.0"), "apply", None)],
        "id BIGINT, batch_id BIGINT, scheme_id BIGINT, scheme_name STRING, source_scheme_id BIGINT, config_version BIGINT, config_json STRING, action STRING, rolled_back_from_id BIGINT")
    return batches, schemes, history


REQUEST = "request_id BIGINT, batch_id BIGINT, scheme_id BIGINT, new_name STRING, source_scheme_id BIGINT"


def test_precheck(spark):
    batches, schemes, _ = registry(spark)
    requests = spark.createDataFrame(
        [(1, 1, 1, None, None), (2, 2, 1, "base", None), (3, 9, 9, None, 9), (4, 1, 2, "free", 1), (5, 1, 3, None, None)], REQUEST)
    found = configs.apply_precheck(requests, batches, schemes)
    got = {r.request_id: ([x.risk for x in r.risks], r.can_proceed, r.new_version) for r in found.collect()}
    assert got == {
        1: ([], True, 2), 2: (["batch_locked", "name_conflict"], False, 2),
        3: (["batch_not_found", "scheme_not_found", "source_missing"], False, None),
        4: (["version_mismatch"], True, 8), 5: (["config_incomplete"], False, 2)}


def test_apply_chains_requests_of_one_batch(spark):
    batches, schemes, history = registry(spark)
    requests = spark.createDataFrame([(1, 1, 1, None, None), (2, 1, 2, None, None), (3, 2, 1, None, None), (4, 3, 2, None, None)], REQUEST)
    done = configs.apply_schemes(requests, batches, schemes, history)
    assert rows_of(done["config_history"], "batch_id", "action", "config_version", "scheme_id") == [
        (1, "apply", 2, 1), (1, "apply", 8, 2), (1, "baseline", 4, None), (3, "apply", 8, 2)]
    audit = {r.request_id: r for r in done["audit_log"].collect()}
    assert audit[1].version_regressed and not audit[2].version_regressed
    assert [(c.path, c.old_value, c.new_value) for c in audit[2].config_diff if "threshold" in c.path] == [("anomaly_detection.zscore_threshold", "2.0", "1.5")]
    assert (audit[3].result, audit[3].error_message) == ("blocked", "batch_locked")
    assert rows_of(done["batches"], "batch_id", "current_scheme_id", "config_version") == [(1, 2, 8), (3, 2, 8)]
    assert done["schemes"].count() == 0


@pytest.mark.parametrize("action, source", [("clone_apply", None), ("derive_apply", 1)])
def test_copy_and_apply(spark, action, source):
    batches, schemes, history = registry(spark)
    requests = spark.createDataFrame([(1, 1, 1, "new", None), (2, 3, 1, "new", None), (3, 2, 1, "locked", None), (4, 3, 1, "second", None), (5, 1, 1, None, None)], REQUEST)
    done = configs.apply_schemes(requests, batches, schemes, history, action)
    assert rows_of(done["schemes"], "scheme_id", "name", "source_scheme_id") == [(5, "new", source), (6, "second", source)]
    assert rows_of(done["audit_log"], "request_id", "result", "error_message") == [
        (1, "success", ""), (2, "blocked", "name_conflict"), (3, "blocked", "batch_locked"), (4, "success", ""), (5, "blocked", "name_missing")]
    applied = done["config_history"].where("action = 'apply'")
    assert rows_of(applied, "batch_id", "scheme_id", "source_scheme_id") == [(1, 5, 1), (3, 6, 1)]


def test_rollback_twice_toggles(spark):
    batches, _, history = registry(spark)
    requests = spark.createDataFrame([(1,), (2,), (3,), (8,)], "batch_id BIGINT")
    checked = configs.rollback_precheck(requests, batches, history)
    assert {r.batch_id: [x.risk for x in r.risks] for r in checked.collect()} == {
        1: ["no_history"], 2: ["batch_locked", "already_first"], 3: [], 8: ["batch_not_found"]}
    first = configs.apply_rollback(requests, batches, history)
    row = first.first()
    assert (first.count(), row.config_version, row.scheme_id, row.rolled_back_from_id) == (1, 3, None, 5)
    again = configs.apply_rollback(requests, batches, history.unionByName(first.withColumn("id", F.lit(9))))
    row = again.first()
    assert (row.config_version, row.scheme_id, row.rolled_back_from_id) == (4, 1, 9)
    assert '"zscore_threshold": 2.0' in row.config_json and '"version": 4' in row.config_json


def test_rollback_tables(spark):
    batches, _, history = registry(spark)
    requests = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 8), (5, 3)], "request_id BIGINT, batch_id BIGINT")
    done = configs.roll_back(requests, batches, history)
    assert rows_of(done["audit_log"], "request_id", "batch_id", "result", "error_message") == [
        (1, 1, "failed", "no_history"), (2, 2, "blocked", "batch_locked"), (3, 3, "success", None), (4, 8, "failed", "batch_not_found")]
    audit = {r.batch_id: r for r in done["audit_log"].collect()}
    assert [(c.path, c.old_value, c.new_value) for c in audit[3].config_diff] == [("version", "1", "3")]
    assert audit[1].config_diff is None and audit[1].previous_config_json and audit[8].previous_config_json is None
    assert rows_of(done["batches"], "batch_id", "current_scheme_id", "config_version") == [(3, None, 3)]
    assert rows_of(done["config_history"], "batch_id", "source_scheme_id", "rolled_back_from_id") == [(3, None, 5)]
    again = history.unionByName(done["config_history"].withColumn("id", F.lit(9).cast("bigint")))
    assert rows_of(configs.apply_rollback(requests.where("request_id = 3"), batches, again), "source_scheme_id") == [(11,)]


def test_dry_runs(spark):
    batches, schemes, history = registry(spark)
    requests = spark.createDataFrame([(1, 1, 1, None, None), (2, 2, 1, None, None), (3, 9, 9, None, 9)], REQUEST)
    found = {r.request_id: r for r in configs.dry_run_audit(configs.apply_precheck(requests, batches, schemes)).collect()}
    assert {i: (r.action, r.result, r.error_message) for i, r in found.items()} == {
        1: ("dry_run", "success", None), 2: ("dry_run", "blocked", "batch_locked"),
        3: ("dry_run", "blocked", "batch_not_found,scheme_not_found,source_missing")}
    assert [c.path for c in found[1].config_diff] == ["version", "anomaly_detection.zscore_threshold"] and found[3].config_diff is None
    checked = configs.rollback_precheck(spark.createDataFrame([(3,), (1,)], "batch_id BIGINT"), batches, history)
    assert [(r.request_id, r.result, len(r.config_diff or [])) for r in configs.dry_run_audit(checked).orderBy("batch_id").collect()] == [
        (1, "blocked", 0), (3, "success", 1)]


@pytest.mark.parametrize("limit", [-1, 10_000_000])
def test_join_on_known_keys(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        left = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(9)] + [(9, "b")], "id BIGINT, name STRING")
        right = spark.createDataFrame([("a", 1), (None, 2)], "name STRING, n INT")
        found = left_join_known(left, right, "name", "id")
        assert found.columns == ["id", "name", "n"]
        assert rows_of(found, "id", "n") == [(i, 1 if i % 3 else None) for i in range(9)] + [(9, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_last_change_and_lineage(spark):
    batches, schemes, history = registry(spark)
    audit = spark.createDataFrame(
        [(1, 1, "apply", "success", 1, '{"version": 3}', '{"version": 2}'), (2, 1, "dry_run", "success", 2, None, None), (3, 3, "rollback", "failed", None, None, None)],
        "id BIGINT, batch_id BIGINT, action STRING, result STRING, scheme_id BIGINT, previous_config_json STRING, new_config_json STRING")
    found = configs.last_change(batches, audit, schemes, history)
    assert rows_of(found, "batch_id", "action", "scheme_name", "old_version", "new_version", "rolled_back_from_id") == [
        (1, "apply", "base", 3, 2, None), (2, None, None, None, None, None), (3, "rollback", None, None, None, None)]
    lineage = {r.scheme_id: (r.source_scheme_name, r.root_id, r.newest_copy_name) for r in configs.scheme_lineage(schemes).collect()}
    assert lineage == {1: (None, 1, "copy"), 2: ("base", 2, None), 3: (None, 3, None), 4: (None, 1, None)}


# --- merge --------------------------------------------------------------------------


def sequential_rename(existing, inputs):
    """Brute force: inputs one by one; the names inputs bring themselves are reserved."""
    taken = set(existing)
    keep, result = {}, {}
    for seq, name, _ in inputs:
        if name not in taken and name not in keep:
            keep[name] = seq
            result[seq] = name
    taken |= set(keep)
    for seq, name, new in inputs:
        if seq not in result and new and new not in taken:
            taken.add(new)
            result[seq] = new
    for seq, name, _ in inputs:
        if seq not in result:
            number, candidate = 0, f"{name}_imported"
            while candidate in taken:
                number += 1
                candidate = f"{name}_imported_{number}"
            taken.add(candidate)
            result[seq] = candidate
    return result


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 15])
def test_rename_equals_brute_force(spark, rows_per_slice):
    rng = random.Random(11)
    names = ["hot", "a", "b", "a_imported", "b_imported_2", "c"]
    existing = ["hot", "hot_imported", "hot_imported_3", "hot_imported_007", "hot_imported_x", "a", "b_imported_1"]
    inputs = [(i, rng.choice(["hot", "hot", *names]), rng.choice([None, None, None, f"given{rng.randint(0, 5)}", "a"])) for i in range(120)]
    found = merge.merge_decisions(
        spark.createDataFrame([(i, n) for i, n in enumerate(existing)], "id BIGINT, name STRING"),
        spark.createDataFrame(inputs, "seq BIGINT, name STRING, new_name STRING"), "rename", rows_per_slice)
    assert dict(rows_of(found, "seq", "final_name")) == sequential_rename(existing, inputs)
    assert found.select("final_name").distinct().count() == 120


@pytest.mark.parametrize("policy, expected", [
    ("reject", [(1, "reject", None), (2, "insert", "b"), (3, "reject", None)]),
    ("skip", [(1, "skip", None), (2, "insert", "b"), (3, "skip", None)]),
    ("overwrite", [(1, "overwrite", "a"), (2, "insert", "b"), (3, "overwrite", "b")]),
])
def test_policies(spark, policy, expected):
    existing = spark.createDataFrame([(7, "a")], "id BIGINT, name STRING")
    incoming = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "seq BIGINT, name STRING")
    assert rows_of(merge.merge_decisions(existing, incoming, policy), "seq", "action", "final_name") == expected
    with pytest.raises(ValueError):
        merge.merge_decisions(existing, incoming, "ask")


def test_merged_table_keeps_roots(spark):
    existing = spark.createDataFrame([(7, "a", "old", None), (8, "z", "old", 3)], "id BIGINT, name STRING, config STRING, original_id BIGINT")
    incoming = spark.createDataFrame([(1, "a", "n1", 42), (2, "b", "n2", 5), (3, "b", "n3", 6)], "seq BIGINT, name STRING, config STRING, original_id BIGINT")
    over = merge.merged_table(existing, incoming, merge.merge_decisions(existing, incoming, "overwrite"), ["config"])
    assert rows_of(over, "id", "name", "config", "original_id") == [(7, "a", "n1", None), (8, "z", "old", 3), (9, "b", "n3", 5)]
    renamed = merge.merged_table(existing, incoming, merge.merge_decisions(existing, incoming, "rename"), ["config"])
    assert rows_of(renamed, "id", "name", "original_name", "original_id") == [
        (10, "b", "b", 5), (11, "b_imported", "b", 6), (7, "a", None, None), (8, "z", None, 3), (9, "a_imported", "a", 42)]


# --- tickets ------------------------------------------------------------------------


def fold(events):
    state = {"status": "open", "assignee": None, "resolution": None, "bad": 0}
    for _, action, payload in sorted(events):
        if action == "create":
            state["status"], state["assignee"] = ("assigned" if payload else "open"), payload
        elif action == "reopen":
            if state["status"] == "resolved":
                state["status"] = "reopened"
            else:
                state["bad"] += 1
        elif action in ("assign", "resolve"):
            if state["status"] == "resolved":
                state["bad"] += 1
            elif action == "assign":
                state["status"], state["assignee"] = "assigned", payload
            else:
                state["status"], state["resolution"] = "resolved", payload
    return state["status"], state["assignee"], state["resolution"], state["bad"]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 20])
def test_ticket_state_equals_the_fold(spark, rows_per_slice):
    rng = random.Random(2)
    logs = {t: [(0, "create", rng.choice([None, "x"]))] + [
        (i, rng.choice(["assign", "resolve", "reopen", "comment"]), f"p{i}") for i in range(1, rng.choice([1, 4, 12, 300]))
    ] for t in range(25)}
    events = spark.createDataFrame([(t, *e) for t, log in logs.items() for e in log], "ticket_id BIGINT, seq BIGINT, action STRING, payload STRING").repartition(4)
    found = tickets.ticket_state(events, rows_per_slice)
    got = {r.ticket_id: (r.status, r.assignee, r.resolution, r.rejected_events) for r in found.collect()}
    assert got == {t: fold(log) for t, log in logs.items()}
    assert tickets.illegal_events(events, rows_per_slice).count() == sum(fold(log)[3] for log in logs.values())


def test_assignee_given_on_resolve(spark):
    events = spark.createDataFrame(
        [(1, 0, "create", None, None), (1, 1, "resolve", "done", "eve"), (2, 0, "create", "x", None), (2, 1, "resolve", "ok", None),
         (3, 0, "create", "x", None), (3, 1, "resolve", "ok", "eve"), (3, 2, "resolve", "again", "bob"), (3, 3, "comment", "c", "zoe")],
        "ticket_id BIGINT, seq BIGINT, action STRING, payload STRING, assignee STRING")
    assert rows_of(tickets.ticket_state(events), "ticket_id", "status", "assignee", "resolution") == [
        (1, "resolved", "eve", "done"), (2, "resolved", "x", "ok"), (3, "resolved", "eve", "ok")]


def test_ticket_conflicts(spark):
    schema = "title STRING, source_batch_id BIGINT, source_run_id BIGINT"
    held = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, 11), (3, "c", 2, None), (4, "d", None, 10)], "ticket_id BIGINT, " + schema)
    incoming = spark.createDataFrame(
        [(1, "a", 2, None), (2, "n", 1, 10), (3, "n", 1, None), (4, "n", None, 10), (5, "n", None, None), (6, "n", 2, 10)], "seq BIGINT, " + schema)
    assert rows_of(tickets.ticket_conflicts(incoming, held), "seq", "conflict_type", "existing_id") == [
        (1, "title_exists", 1), (2, "source_exists", 1), (3, "source_exists", 2), (4, "source_exists", 4), (5, None, None), (6, None, None)]


def test_long_timelines_go_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tickets, "NOTES_PER_DOCUMENT", 3)
    held = spark.createDataFrame([(1, None), (2, 9)], "ticket_id BIGINT, original_ticket_id BIGINT")
    notes = spark.createDataFrame([(1, i, "me", "comment", f"n{i}") for i in range(8)],
        "ticket_id BIGINT, note_id BIGINT, author STRING, note_type STRING, content STRING")
    found = tickets.ticket_documents(held, notes, rows_per_slice=2)
    assert [(r.ticket_id, r.part, r.original_ticket_id, [n.note_id for n in r.notes]) for r in found.orderBy("ticket_id", "part").collect()] == [
        (1, 0, 1, [0, 1, 2]), (1, 1, 1, [3, 4, 5]), (1, 2, 1, [6, 7]), (2, 0, 9, [])]


def test_raised_tickets(spark):
    verdicts = spark.createDataFrame([("a", "block"), ("b", "warn"), ("c", "block")], "batch_id STRING, check_status STRING")
    counts = spark.createDataFrame([("a", None, 9), ("a", "s", 9), ("b", None, 2)], "batch_id STRING, sensor STRING, anomalies BIGINT")
    open_ = spark.createDataFrame([("c", "baseline_blocked")], "batch_id STRING, trigger_rule STRING")
    assert rows_of(tickets.raise_tickets(verdicts, counts, open_, 5), "batch_id", "trigger_rule") == [
        ("a", "baseline_blocked"), ("a", "too_many_anomalies")]


# --- runs and listings --------------------------------------------------------------


def test_runs(spark):
    batches = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "batch_id BIGINT, locked BOOLEAN")
    runs = spark.createDataFrame([(10, 1, "success"), (12, 1, "failed"), (11, 2, "success"), (13, 4, "pending")], "run_id BIGINT, batch_id BIGINT, run_status STRING")
    assert rows_of(catalog.latest_run(runs), "run_id") == [(11,), (12,), (13,)]
    assert rows_of(catalog.latest_run(runs, "success"), "run_id") == [(10,), (11,)]
    assert rows_of(catalog.batch_status(batches, runs), "batch_id", "batch_status") == [(1, "failed"), (2, "locked"), (3, "pending"), (4, "pending")]
    numbered = catalog.number_runs(runs)
    assert rows_of(numbered, "run_id", "run_number") == [(10, 1), (11, 1), (12, 2), (13, 1)]
    more = spark.createDataFrame([(20, 1), (21, 1), (22, 9)], "run_id BIGINT, batch_id BIGINT")
    assert rows_of(catalog.append_numbers(numbered, more), "run_id", "run_number") == [(20, 3), (21, 4), (22, 1)]
    requests = spark.createDataFrame([(1,), (2,), (7,)], "batch_id BIGINT")
    assert rows_of(catalog.eligible_batches(batches, requests), "batch_id") == [(1,)]


def test_listings(spark):
    log = spark.createDataFrame([(i, "apply" if i % 2 else "rollback", "x") for i in range(10)], "id INT, action STRING, wide STRING")
    assert [r.id for r in catalog.newest_first(log, 3, action="apply", wide=None).collect()] == [9, 7, 5]
    listed = catalog.listing(log, ["id"], F.desc("id"))
    assert listed.columns == ["id"] and listed.first().id == 9


# --- documents of any shape ---------------------------------------------------------


@pytest.mark.parametrize("old, new, expected", [
    ('{"a":{"b":{"c":{"d":1,"e":2}}}}', '{"a":{"b":{"c":{"e":2,"d":1}}}}', []),
    ('{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":{"e":2}}}}}', [("a.b.c.d.e", "modified", "1", "2")]),
    ('{"note":"{draft}","version":1}', '{"note":"{draft}","version":2}', [("version", "modified", "1", "2")]),
    ('{"x":[1,2]}', '{"x":[1,2.0]}', []),
    ('{"x":"1"}', '{"x":1}', [("x", "modified", "1", "1")]),
    ('{"x":"true"}', '{"x":true}', [("x", "modified", "true", "true")]),
    ('{"x":true}', '{"x":1}', []),
    ('{"x":9007199254740993}', '{"x":9007199254740992}', [("x", "modified", "9007199254740993", "9007199254740992")]),
    ('{"a.b":1,"a":{"b":2}}', '{"a":{"b":3}}', [("a.b", "modified", "2", "3")]),
    ('{"x":0.50,"y":null}', '{"x":0.5,"z":null}', [("y", "removed", None, None), ("z", "added", None, None)]),
    ('{"x":{}}', '{}', []), (None, '{"x":1}', [("x", "added", None, "1")]), ("no json", "[1]", []),
])
def test_config_changes(spark, old, new, expected):
    pairs = spark.createDataFrame([(1, old, new)], "k INT, old_json STRING, new_json STRING")
    assert rows_of(configs.config_diff(pairs, ["k"]), "path", "change", "old_value", "new_value") == expected


def nested(depth, value):
    return '{"a":' * depth + value + "}" * depth


@pytest.mark.parametrize("old, new, expected", [
    (nested(300, "1"), nested(300, "2"), [(".".join("a" * 300), "modified", "1", "2")]),
    (nested(20000, "1"), nested(20000, "2"), [("", "unreadable", nested(20000, "1"), nested(20000, "2"))]),
    (nested(20000, "1"), nested(20000, "1"), []),
    ('{"a":{"b":1,"b":2},"c":1}', '{"c":1}', [("", "unreadable", '{"a":{"b":1,"b":2},"c":1}', None), ("c", "added", None, "1")]),
    ('{"a":', '{"a":1}', [("", "unreadable", '{"a":', None), ("a", "added", None, "1")]),
    ('{"a":1,"a":2}', '{"a":2}', []), ('{"x":1e2,"y":[1e1]}', '{"x":100,"y":[10]}', []),
    ('{"s":"{\\"v\\":1}","t":"[1]"}', '{"s":{"v":1},"t":[1]}', [
        ("s", "removed", '{"v":1}', None), ("s.v", "added", None, "1"), ("t", "modified", "[1]", "[1]")]),
    ('{"":{"x":1}}', '{"":{"x":2}}', [("x", "modified", "1", "2")]),
    ('{"x":null}', '{"x":"null"}', [("x", "modified", None, "null")]),
])
def test_config_changes_of_odd_documents(spark, old, new, expected):
    pairs = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, None)], "k INT, old_json STRING, new_json STRING")
    assert rows_of(configs.config_diff(pairs, ["k"]), "path", "change", "old_value", "new_value") == expected


def test_changes_come_in_the_order_of_the_documents_without_python(spark):
    old, new = '{"z":1,"b":{"y":1,"x":2},"gone":0}', '{"new":1,"b":{"x":3,"y":2},"z":2}'
    pairs = spark.createDataFrame([(i, old, new, "k") for i in range(3)] + [(7, new, new, "k")], "id INT, old_json STRING, new_json STRING, path STRING")
    found = {r.id: [c.path for c in r.config_diff] for r in configs.with_changes(pairs).collect()}
    assert found == {7: [], **dict.fromkeys(range(3), ["z", "b.y", "b.x", "gone", "new"])}
    for made in (configs.with_changes(pairs), configs.config_diff(pairs, ["id"])):
        plan = made._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("text, expected", [
    (nested(20000, "1"), '{"version": 9, ' + nested(20000, "1")[1:]), ('{"v":"}\\"]","version":{"version":"{"}}', '{"v":"}\\"]","version":9}'),
    ("[" * 20000, None),
    ('{"cleaning":{"remove_duplicates":true,"custom":7},"owner":"x","version":1}', '{"cleaning":{"remove_duplicates":true,"custom":7},"owner":"x","version":9}'),
    ('{"version":1.5, "a":"{"}', '{"version":9, "a":"{"}'), ('{ }', '{"version": 9 }'),
    ('{"a":{"version":1}}', '{"version": 9, "a":{"version":1}}'), ('{"version":{"x":[1]},"b":1e3}', '{"version":9,"b":1e3}'),
    (None, None), ("[1]", None), ("broken", None),
])
def test_version_rewrite_keeps_everything_else(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t STRING").select(with_version(F.col("t"), F.lit(9)).alias("v")).first()
    assert row.v == expected


def test_infinite_metrics_compare(spark):
    inf, nan = float("inf"), float("nan")
    same = metric_frame(spark, [("a", "s", "max", inf), ("a", "s", "std", nan), ("a", "s", "min", 1.0)])
    verdict = replay.replay_verdict(replay.replay_comparison(same, same)).first()
    assert verdict.acceptable and verdict.metrics_with_diff == 0
    both = same.union(metric_frame(spark, [("b", "s", "max", inf), ("b", "s", "min", 3.0)]))
    matrix = compare.metric_matrix(both)
    assert compare.matrix_summary(matrix).first().metrics_with_diff == 1
    assert [r.metric_name for r in compare.top_differences(matrix).collect()] == ["min"]


def test_copies_of_names_taken_several_times(spark):
    """Names that several schemes have stop a request once, and unnamed requests stay out of the joins by name."""
    batches, schemes, history = registry(spark)
    schemes = schemes.unionByName(schemes.where("scheme_id = 1").withColumn("scheme_id", F.lit(7).cast("bigint")))
    requests = spark.createDataFrame(
        [(1, 1, 1, "base", None), (2, 1, 1, None, None), (3, 2, 1, None, None), (4, 1, 1, "new", None), (5, 3, 1, "new", None)], REQUEST)
    done = configs.apply_schemes(requests, batches, schemes, history, "derive_apply")
    assert rows_of(done["schemes"], "scheme_id", "name") == [(8, "new")]
    assert rows_of(done["audit_log"], "request_id", "result", "error_message") == [
        (1, "blocked", "name_conflict"), (2, "blocked", "name_missing"), (3, "blocked", "batch_locked,name_missing"),
        (4, "success", ""), (5, "blocked", "name_conflict")]


def test_metric_keys_are_those_of_the_statistics(spark):
    readings = spark.createDataFrame(
        [("d", i, i, sensor, value) for i, (sensor, value) in enumerate([("s", 1.0), ("s", None), ("t", 2.0), ("u", None), (None, 3.0)])],
        "batch_id STRING, row_number LONG, ts LONG, sensor STRING, value DOUBLE")
    for imputed in (readings, impute.fill_constant(readings)):
        found, expected = metrics.metric_keys(imputed), metrics.metric_rows(metrics.series_stats(imputed)).select("sensor", "metric_name")
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.distinct().collect()))
    assert metrics.metric_keys(readings.limit(0)).collect() == []


def lines_of(spark, folder, keys):
    spark.createDataFrame([(k, 1.0, None) for k in keys], "l_orderkey LONG, l_quantity DOUBLE, l_extendedprice DOUBLE").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("keys", [[], [None], [1, 1, 2]])
def test_keys_of_run_metrics(spark, tmp_path, keys):
    folder = lines_of(spark, tmp_path, keys)
    expected = bindings.run_metrics(spark, folder).select("sensor", "metric_name").distinct()
    assert sorted(bindings.run_metric_keys(spark, folder).collect()) == sorted(expected.collect())


def test_key_union_gathers_keys_only(spark, tmp_path):
    """No aggregate by run or by time: the memory of a task does not grow with the input."""
    folder = lines_of(spark, tmp_path, [1, 2])
    spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 'view' AS event_type, 1.0D AS value").write.parquet(f"{folder}/events.parquet")
    found = QUERIES["metric_key_union"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = [re.sub(r"#\d+L?", "", g) for g in re.findall(r"Aggregate \[([^\]]*)\]", plan)]
    assert len(grouped) >= 3 and set(grouped) <= {"count(1) AS n", "sensor", "sensor, metric_name"} and "Window" not in plan
    assert found.count() == 13
