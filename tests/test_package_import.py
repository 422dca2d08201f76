"""Packages imported into a registry, round after round."""

import pytest

from batchgauge.operators import package_import
from batchgauge.sinks import exports
from batchgauge.sources import documents, integrity
from helpers import rows_of


def package(spark, path, rows, checks=()):
    baselines = spark.createDataFrame(rows, "baseline_id BIGINT, name STRING, source_batch_id BIGINT, config_json STRING")
    thresholds = spark.createDataFrame([(r[0], f"s{r[0]}", 1.5) for r in rows], "baseline_id BIGINT, sensor STRING, baseline_value DOUBLE")
    history = spark.createDataFrame(list(checks), "id BIGINT, baseline_id BIGINT, check_status STRING")
    source = spark.createDataFrame([(7, 100)], "batch_id BIGINT, total_rows BIGINT")
    exports.write_package(path, exports.baseline_package(baselines, thresholds, history, source_summary=source))
    return documents.read_package(spark, path, integrity.BASELINE_FILES)


ROWS = [(1, "a", 7, '{"version": 1}'), (2, "b", 8, None), (3, "c", None, "{}")]


@pytest.mark.parametrize("policy, stored, results", [
    ("reject", [(12, "b", 2), (13, "c", 3)], {"a": ("blocked", "reject"), "b": ("success", None), "c": ("success", None)}),
    ("skip", [(12, "b", 2), (13, "c", 3)], {"a": ("success", "skip"), "b": ("success", None), "c": ("success", None)}),
    ("rename", [(12, "a_imported_1", 1), (13, "b", 2), (14, "c", 3)], {"a": ("success", "rename"), "b": ("success", None), "c": ("success", None)}),
])
def test_policies(spark, tmp_path, policy, stored, results):
    existing = spark.createDataFrame([(5, "a"), (11, "a_imported")], "id BIGINT, name STRING")
    read = package(spark, str(tmp_path / "p"), ROWS, [(1, 1, "warn"), (2, 1, "pass"), (3, 2, "block")])
    made = package_import.import_baselines(existing, read, policy, "/p")
    assert rows_of(made["baselines"], "baseline_id", "name", "original_id") == stored
    assert {r.original_name: (r.result, r.conflict_action) for r in made["audit_log"].collect()} == results
    by_origin = {r.original_id: r for r in made["baselines"].collect()}
    assert by_origin[2].last_check_status == "block" and by_origin[3].last_check_status is None and by_origin[2].source_batch_id is None
    new = {r.original_id: r.baseline_id for r in made["baselines"].collect()}
    assert rows_of(made["metric_thresholds"], "baseline_id", "sensor") == sorted((i, f"s{o}") for o, i in new.items())
    assert rows_of(made["source_summary"], "baseline_id", "batch_id") == ([(new[1], 7)] if 1 in new else [])
    if policy == "rename":
        assert by_origin[1].config_json == '{"version": 1}' and by_origin[1].last_check_status == "pass"


def test_explicit_names_and_unknown_policies(spark):
    existing = spark.createDataFrame([(1, "a")], "id BIGINT, name STRING")
    entries = spark.createDataFrame([(1, "a", "mine"), (2, "a", "mine"), (3, "a", None)], "k BIGINT, name STRING, new_name STRING")
    made = package_import.import_entries(existing, entries, "k", "rename", "x", "/p")
    assert rows_of(made["entries"], "k", "name") == [(2, "mine"), (3, "a_imported"), (4, "a_imported_1")]
    with pytest.raises(ValueError):
        package_import.import_entries(existing, entries, "k", "overwrite", "x", "/p")
    nothing = package_import.import_entries(existing, entries.limit(0), "k", "reject", "x", "/p")
    assert nothing["entries"].count() == 0 and nothing["audit_log"].count() == 0


def test_exported_and_imported_again(spark, tmp_path):
    registry = spark.createDataFrame([], "id BIGINT, name STRING")
    rows = ROWS
    for generation in range(2):
        made = package_import.import_baselines(registry, package(spark, str(tmp_path / str(generation)), rows), "reject", f"/p{generation}")
        found = sorted((r.baseline_id, r.name, r.source_batch_id, r.config_json) for r in made["baselines"].collect())
        assert [r[1:] for r in found] == [(n, None, c) for _, n, _, c in ROWS]
        rows = [(i + 10, n, b, c) for i, n, b, c in found]
    assert rows_of(made["baselines"], "baseline_id", "original_id") == [(1, 11), (2, 12), (3, 13)]
