import hashlib
import json

import pytest
from pyspark.sql import functions as F

from batchgauge.functions.settings import missing_sections, read_config, version_compatible
from batchgauge.operators import merge, validate
from batchgauge.operators import tickets as review
from batchgauge.operators.replay import capped, snapshot_manifest
from batchgauge.sinks import exports
from batchgauge.sources import csv_files, documents, integrity
from helpers import SAMPLE, rows_of


def write(path, text, **kw):
    path.write_bytes(text.encode(kw.get("encoding", "utf-8")))


def test_line_numbers_across_splits(spark, tmp_path):
    """Small splits: every file is read by several tasks, numbers stay physical."""
    for name, end in (("a", "\n"), ("b", "\r\n")):
        write(tmp_path / f"{name}.csv", end.join(["timestamp,v"] + [f"{i}" if i % 50 else "" for i in range(2, 3001)]) + end)
    write(tmp_path / "c.csv", "timestamp,v\nx")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = csv_files.file_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, count in (("a", 3000), ("b", 3000), ("c", 2)):
        of = {r.row_number: r.line for r in rows if r.file_path.endswith(f"{name}.csv")}
        assert sorted(of) == list(range(1, count + 1))
        if name != "c":
            assert all(of[i] == (str(i) if i % 50 else "") for i in range(2, count + 1))


def test_no_line_is_lost_when_the_split_layout_changes(spark, tmp_path):
    write(tmp_path / "a.csv", "".join(f"{i}\n" for i in range(1, 20_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        lines = csv_files.file_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "11000")
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_number, r.line) for r in rows) == [(i, str(i)) for i in range(1, 20_001)]


def test_scan_sample_with_bom(spark, tmp_path):
    write(tmp_path / "plain.csv", SAMPLE)
    write(tmp_path / "bom.csv", "﻿" + SAMPLE)
    lines = csv_files.file_lines(spark, str(tmp_path)).withColumn("batch_id", csv_files.file_name(F.col("file_path")))
    readings = validate.readings_of(csv_files.scan(lines))
    sides = [rows_of(readings.where(F.col("batch_id") == n), "row_number", "sensor", "value") for n in ("plain.csv", "bom.csv")]
    assert sides[0] == sides[1] and len(sides[0]) == 51


def test_empty_files_are_listed(spark, tmp_path):
    write(tmp_path / "e.csv", "")
    write(tmp_path / "f.csv", SAMPLE)
    listed = csv_files.listed_files(spark, str(tmp_path)).withColumn("batch_id", csv_files.file_name(F.col("file_path")))
    lines = csv_files.file_lines(spark, str(tmp_path)).withColumn("batch_id", csv_files.file_name(F.col("file_path")))
    assert rows_of(validate.rejected_files(listed, lines), "batch_id", "reason") == [("e.csv", "empty_file")]


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_fingerprints(spark, tmp_path, limit):
    write(tmp_path / "a.txt", "abc")
    write(tmp_path / "b c.txt", "x" * 1000)
    found = integrity.fingerprints(spark, str(tmp_path), limit)
    expected = {
        name: (size, hashlib.sha256(data).hexdigest())
        for name, size, data in (("a.txt", 3, b"abc"), ("b c.txt", 1000, b"x" * 1000))
    }
    got = {r.file_name.replace("%20", " "): (r.file_size, r.sha256) for r in found.collect()}
    assert got == expected


def test_package_checks(spark):
    actual = spark.createDataFrame(
        [("p", n, "1") for n in integrity.BASELINE_FILES] + [("q", "config.json", "1")],
        "package STRING, file_name STRING, sha256 STRING")
    listed = spark.createDataFrame(
        [("p", "config.json", "1"), ("p", "source_summary.json", "2"), ("p", "gone.json", "1"), ("p", "checksum.json", "9")],
        "package STRING, file_name STRING, sha256 STRING")
    problems = rows_of(integrity.check_packages(actual, listed, integrity.BASELINE_FILES), "package", "file_name", "problem")
    assert ("p", "source_summary.json", "checksum_mismatch") in problems
    assert sum(p[0] == "p" for p in problems) == 1
    assert sum(p[0] == "q" and p[2] == "missing_file" for p in problems) == 5
    manifests = spark.createDataFrame([("a", "1.0"), ("b", "1.7"), ("c", "2.0"), ("d", None)], "package STRING, format_version STRING")
    assert rows_of(integrity.incompatible_packages(manifests), "package") == [("c",), ("d",)]


def scheme(name, version="1.0", drop=None, **more):
    config = {"version": 3, "cleaning": {}, "missing_values": {"strategy": "drop"}, "metrics": {}, "anomaly_detection": {"method": "iqr"}}
    config.pop(drop, None)
    return {"name": name, "scheme_version": version, "config": config, **more}


def test_scheme_files_and_import(spark, tmp_path):
    for i, doc in enumerate([
        scheme("a", original_id=7, exported_at="2025-01-01"), scheme("b", "99.0"), scheme("c", drop="cleaning"), scheme("d"),
    ]):
        write(tmp_path / f"{i}.json", json.dumps(doc))
    loaded = documents.read_schemes(spark, str(tmp_path))
    assert loaded.count() == 4
    assert loaded.where("name = 'a'").first().imported_from.endswith("0.json@2025-01-01")
    incoming = loaded.select(
        F.col("name"), F.ascii("name").cast("bigint").alias("seq"),
        version_compatible(F.col("scheme_version"), "1.0").alias("compatible"),
        missing_sections(F.col("config")).alias("missing"),
    )
    existing = spark.createDataFrame([(1, "d")], "id BIGINT, name STRING")
    strict = merge.scheme_import_decisions(existing, incoming, "rename")
    assert rows_of(strict, "name", "action", "final_name", "reason") == [
        ("a", "insert", "a", None), ("b", "reject", None, "version_mismatch"),
        ("c", "reject", None, "missing_fields"), ("d", "rename", "d_imported", None),
    ]
    lenient = merge.scheme_import_decisions(existing, incoming, "overwrite", strict=False)
    assert rows_of(lenient, "name", "action") == [("a", "insert"), ("b", "insert"), ("c", "insert"), ("d", "overwrite")]
    skipping = merge.scheme_import_decisions(existing, incoming, "skip", strict=False)
    assert rows_of(skipping, "name", "action") == [("a", "insert"), ("b", "skip"), ("c", "skip"), ("d", "skip")]
    flat = read_config(loaded.where("name = 'a'").select("name", "config"), "config").first()
    assert (flat.version, flat.strategy, flat.method, flat.max_interpolate_gap, flat.compute_std) == (3, "drop", "iqr", 5, True)


def test_ticket_files(spark, tmp_path):
    note = {"author": "x", "note_type": "comment", "content": "hi", "created_at": "t"}
    write(tmp_path / "t.json", json.dumps({"title": "T", "status": "open", "original_ticket_id": 4, "notes": [note, {**note, "content": "ho"}]}))
    tickets = documents.read_tickets(spark, str(tmp_path))
    assert rows_of(documents.ticket_notes(tickets), "title", "seq", "content") == [("T", 0, "hi"), ("T", 1, "ho")]


def test_tickets_in_parts_come_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(review, "NOTES_PER_DOCUMENT", 3)
    held = spark.createDataFrame([(1, "T", None), (2, "U", 9)], "ticket_id BIGINT, title STRING, original_ticket_id BIGINT")
    notes = spark.createDataFrame([(1, i, "me", "comment", f"n{i}", f"t{i}") for i in range(8)],
        "ticket_id BIGINT, note_id BIGINT, author STRING, note_type STRING, content STRING, created_at STRING")
    path = exports.write_json(review.ticket_documents(held, notes), str(tmp_path / "tickets"))
    assert rows_of(documents.read_tickets(spark, path, lines=True), "title", "original_ticket_id") == [("T", 1), ("U", 9)]
    timeline = documents.ticket_notes(documents.read_ticket_parts(spark, path, lines=True))
    assert rows_of(timeline, "seq", "title", "content", "created_at") == [(i, "T", f"n{i}", f"t{i}") for i in range(8)]


def test_csv_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "batch_id INT, v STRING")
    exports.write_csv(empty, str(tmp_path / "empty"))
    text = "".join(p.read_text() for p in (tmp_path / "empty").glob("*.csv"))
    assert text.strip() == "batch_id,v"
    with pytest.raises(ValueError):
        exports.require_rows(empty, "metrics")
    exports.write_csv(spark.createDataFrame([(1, "a"), (2, "b")], "batch_id INT, v STRING"), str(tmp_path / "two"), by_batch=True)
    assert (tmp_path / "two" / "batch_id=1").exists()


def test_result_set_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("s", "mean", 1.5)], "sensor STRING, metric_name STRING, metric_value DOUBLE")
    anomalies = spark.createDataFrame([(r, i) for r in (1, 2) for i in range(5)], "run_id INT, id INT")
    path = exports.write_result_set(str(tmp_path / "set"), {"metrics": metrics, "anomalies": anomalies}, {"anomalies": ("run_id", "id", 3)})
    assert documents.read_result_set(spark, path, "metrics").collect() == metrics.collect()
    assert rows_of(documents.read_result_set(spark, path, "manifest_anomalies"), "run_id", "id") == [(r, i) for r in (1, 2) for i in range(3)]
    assert documents.read_result_set(spark, path, "anomalies").count() == 10
    assert capped(anomalies, "run_id", "id", 1).count() == 2
    write(tmp_path / "set" / "old.json", json.dumps([{"sensor": "s"}, {"sensor": "t"}]))
    assert documents.read_result_set(spark, path, "old", "sensor STRING").count() == 2


def test_packages_pass_their_own_check(spark, tmp_path):
    runs = spark.createDataFrame(
        [(1, 7, 1, 2, 10, 1, '{"b": 1, "a": [1.50, "é"]}'), (2, 7, 2, 2, 0, 0, "no json")],
        "run_id BIGINT, batch_id BIGINT, run_number BIGINT, config_version BIGINT, rows_processed BIGINT, rows_errors BIGINT, config_json STRING")
    batches = spark.createDataFrame([(7, "seven", "/d/x.csv")], "batch_id BIGINT, batch_name STRING, source_file STRING")
    metrics = spark.createDataFrame([(1, "s", "mean", 1.5)], "run_id BIGINT, sensor STRING, metric_name STRING, metric_value DOUBLE")
    anomalies = spark.createDataFrame(
        [(1, "zscore (z=3.10)"), (1, "zscore (z=4.00)"), (1, "iqr (above_upper: [1, 2])"), (3, "x")], "run_id BIGINT, anomaly_type STRING")
    errors = spark.createDataFrame([], "run_id BIGINT, error_type STRING")
    manifest = snapshot_manifest(runs, batches, metrics, anomalies, errors)
    first, second = manifest.orderBy("run_id").collect()
    assert [tuple(k) for k in first.anomaly_type_counts] == [("iqr", 1), ("zscore", 2)] and second.anomaly_type_counts == []
    assert first.config_sha256 == hashlib.sha256('{"a": [1.5, "é"], "b": 1}'.encode()).hexdigest() and second.config_sha256 is None
    summary = spark.createDataFrame([(7, 10)], "batch_id BIGINT, total_rows BIGINT")
    parts = exports.snapshot_package(manifest, metrics, anomalies, errors, summary, {"pyspark": "4"})
    path = exports.write_package(str(tmp_path / "p"), parts)
    assert integrity.check_written(spark, path, integrity.SNAPSHOT_FILES).count() == 0
    read = documents.read_package(spark, path, integrity.SNAPSHOT_FILES)
    assert read["anomalies"].count() == 3 and read["metrics"].collect() == metrics.collect() and read["errors"].count() == 0
    file = next((tmp_path / "p" / "metrics").glob("part-*.parquet"))
    content = file.read_bytes()
    for crc in (tmp_path / "p").rglob(".*.crc"):
        crc.unlink()
    file.write_bytes(content + b"x")
    write(tmp_path / "p" / "errors" / "more.parquet", "x")
    for old in (tmp_path / "p" / "source_summary").iterdir():
        old.unlink()
    found = rows_of(integrity.check_written(spark, path, integrity.SNAPSHOT_FILES), "problem", "file_name")
    assert ("checksum_mismatch", f"metrics/{file.name}") in found and ("unlisted_file", "errors/more.parquet") in found
    assert ("missing_file", "source_summary") in found
    with pytest.raises(ValueError, match="missing_file|checksum_mismatch"):
        documents.read_package(spark, path, integrity.SNAPSHOT_FILES)


def test_comparison_document(spark, tmp_path):
    one = spark.createDataFrame([("a", 1)], "batch_id STRING, n INT")
    doc = exports.comparison_document("report", one, one, one)
    exports.write_comparison(str(tmp_path / "cmp"), doc)
    back = spark.read.text(str(tmp_path / "cmp"))
    assert rows_of(back.groupBy("part").count(), "part", "count") == [("batch", 1), ("metric", 1), ("report", 1)]
    assert json.loads(doc.where("part = 'report'").first().value) == {"name": "report", "anomalies": {"batch_id": "a", "n": 1}}


def test_comparison_csv(spark, tmp_path):
    batches = spark.createDataFrame([("a",), ("b",)], "batch_id STRING")
    summary = exports.comparison_summary("r", batches, ("s", "1.0"))
    assert tuple(summary.first()) == ("r", "s", "1.0", 2)
    with pytest.raises(Exception, match="at least 2 batches"):
        exports.comparison_summary("r", batches.limit(1)).collect()
    tables = dict.fromkeys(("batches", "metrics", "anomalies", "range"), batches)
    paths = exports.write_comparison_csv(str(tmp_path / "r"), {"summary": summary, **tables})
    assert spark.read.csv(paths["summary"], header=True).first().batch_count == "2"
    with pytest.raises(ValueError):
        exports.write_comparison_csv(str(tmp_path / "x"), tables)


def test_scheme_export_and_baseline_package(spark, tmp_path):
    schemes = spark.createDataFrame([(5, "a", "1.0", "{}", None, 2), (6, "b", "1.0", "{}", 5, None)],
        "scheme_id BIGINT, name STRING, scheme_version STRING, config_json STRING, source_scheme_id BIGINT, original_id BIGINT")
    exports.write_json(exports.scheme_documents(schemes), str(tmp_path / "s"))
    assert rows_of(spark.read.json(str(tmp_path / "s")), "name", "original_id") == [("a", 2), ("b", 6)]
    baselines = spark.createDataFrame([(1, "x")], "baseline_id BIGINT, name STRING")
    checks = spark.createDataFrame([(i, 1, "pass") for i in range(60)], "id BIGINT, baseline_id BIGINT, check_status STRING")
    thresholds = spark.createDataFrame([(1, "s"), (2, "s")], "baseline_id BIGINT, sensor STRING")
    parts = exports.baseline_package(baselines, thresholds, checks)
    assert parts["check_history"].count() == 60 and parts["metric_thresholds"].count() == 1
    assert parts.keys() == {"baseline_summary", "config", "metric_thresholds", "source_summary", "check_history"}
    path = exports.write_package(str(tmp_path / "b"), parts)  # without a configuration or a source: empty parts
    assert integrity.check_written(spark, path, integrity.BASELINE_FILES).count() == 0
    assert documents.read_package(spark, path, integrity.BASELINE_FILES)["config"].count() == 0
    assert parts["baseline_summary"].first().check_history_count == 60
    newest = exports.baseline_package(baselines, thresholds, checks, newest_checks=50)["newest_checks"]
    assert sorted(r.id for r in newest.collect()) == list(range(10, 60))


def test_baseline_package_holds_configuration_and_source(spark, tmp_path):
    baselines = spark.createDataFrame([(1, "x", 7, '{"version": 1}'), (2, "y", 8, None)],
        "baseline_id BIGINT, name STRING, source_batch_id BIGINT, config_json STRING")
    checks = spark.createDataFrame([], "id BIGINT, baseline_id BIGINT, check_status STRING")
    thresholds = spark.createDataFrame([(1, "s")], "baseline_id BIGINT, sensor STRING")
    source = spark.createDataFrame([(7, 100, ["a", "b"]), (9, 5, ["c"])], "batch_id BIGINT, total_rows BIGINT, columns ARRAY<STRING>")
    path = exports.write_package(str(tmp_path / "p"), exports.baseline_package(baselines, thresholds, checks, source_summary=source))
    read = documents.read_package(spark, path, integrity.BASELINE_FILES)
    assert rows_of(read["config"], "baseline_id", "config_json") == [(1, '{"version": 1}')]
    assert [(r.baseline_id, r.batch_id, r.columns) for r in read["source_summary"].collect()] == [(1, 7, ["a", "b"])]
    assert rows_of(read["baseline_summary"], "baseline_id", "check_history_count") == [(1, 0), (2, 0)]


# --- tree digests -------------------------------------------------------------------


def tree_of(data, block):
    sha = lambda text: hashlib.sha256(text).hexdigest()
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    leaves = [sha("".join(map(sha, lines[i : i + block])).encode()) for i in range(0, len(lines), block)]
    nodes = [sha("".join(leaves[i : i + integrity.NODE_BLOCKS]).encode()) for i in range(0, len(leaves), integrity.NODE_BLOCKS)]
    top = sha("".join(nodes).encode()) if nodes else ""
    return sha(f"{block}:{len(data)}:{top}".encode())


@pytest.mark.parametrize("nodes, split", [(10_000, 1 << 20), (3, 64)])
def test_tree_digests(spark, tmp_path, monkeypatch, nodes, split):
    monkeypatch.setattr(integrity, "NODE_BLOCKS", nodes)
    files = {"a.csv": b"x\r\ny\n" * 40, "b.csv": b"".join(b"line %d\n" % i for i in range(95)), "c.csv": b"no line feed", "e.csv": b"", "z.bin": b"\xff\x00\n\n\xfe"}
    (tmp_path / "in" / "k=1").mkdir(parents=True)
    for name, data in files.items():
        (tmp_path / "in" / "k=1" / name).write_bytes(data)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = {r.file_name: (r.file_size, r.tree_sha256) for r in integrity.tree_digests(spark, str(tmp_path / "in"), 10).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found == {name: (len(data), tree_of(data, 10)) for name, data in files.items() if data}


def test_changed_blocks_are_located(spark, tmp_path):
    lines = [f"line {i}" for i in range(95)]
    sides = []
    for side, change in (("old", {}), ("new", {42: "changed"})):
        folder = tmp_path / side
        folder.mkdir()
        write(folder / "f.csv", "\n".join(change.get(i, line) for i, line in enumerate(lines)) + ("\n" if side == "old" else "\nmore\n" * 10))
        sides.append(integrity.block_digests(spark, str(folder), 10).withColumn("name", csv_files.file_name(F.col("file_path"))))
    assert sorted(map(tuple, integrity.changed_blocks(*sides, keys=["name"]).collect())) == [
        ("f.csv", 4, "modified"), ("f.csv", 9, "modified"), ("f.csv", 10, "added"), ("f.csv", 11, "added")]


# --- reports ------------------------------------------------------------------------


def report_of(spark, batches=3):
    kind = "batch_id BIGINT, "
    summaries = spark.createDataFrame(
        [(i, f'b"{i}', i % 2 == 0, None if i == 1 else i * 10) for i in range(1, batches + 1)], kind + "batch_name STRING, locked BOOLEAN, rows_processed INT")
    metrics = spark.createDataFrame(
        [(i, s, m, float(i * k)) for i in range(1, batches + 1) for k, (s, m) in enumerate((("x", "max"), ("x", "mean"), ("y", "max"))) if (i, s) != (1, "y")],
        kind + "sensor STRING, metric_name STRING, metric_value DOUBLE")
    counts = spark.createDataFrame(
        [(i, None, i) for i in range(2, batches + 1)] + [(i, "y", i - 1) for i in range(2, batches + 1)] + [(2, "x", 1)],
        kind + "sensor STRING, anomalies BIGINT")
    return summaries, metrics, counts


def whole(path):
    return "".join((path / f).read_text() for f in sorted(f.name for f in path.iterdir() if f.name.startswith("part-")))


@pytest.mark.parametrize("scheme", [None, (3, "s", "1.0")])
def test_comparison_is_one_document(spark, tmp_path, scheme):
    from batchgauge.sinks import reports

    fragments = reports.comparison_fragments("r", "2025-01-01T00:00:00", *report_of(spark), scheme)
    reports.write_document(str(tmp_path / "doc"), fragments)
    found = json.loads(whole(tmp_path / "doc"))
    assert found["name"] == "r" and found["generated_at"] == "2025-01-01T00:00:00"
    assert found["scheme"] == dict(zip(("id", "name", "version"), scheme or (None, None, None)))
    assert [b["batch_id"] for b in found["batch_summaries"]] == [1, 2, 3] and found["batch_summaries"][0]["rows_processed"] is None
    assert found["metrics_diff"]["summary"] == {"total_metrics_compared": 3, "metrics_with_diff": 2, "batch_keys": ['1:b"1', '2:b"2', '3:b"3']}
    assert list(found["metrics_diff"]["per_metric"]) == ["x::max", "x::mean", "y::max"]
    assert found["metrics_diff"]["per_metric"]["y::max"] == {
        "sensor": "y", "metric": "max", "values": {'2:b"2': 4.0, '3:b"3': 6.0}, "abs_diff": 2.0, "rel_diff_pct": 50.0}
    assert found["metrics_diff"]["per_metric"]["x::max"]["rel_diff_pct"] is None
    assert found["anomalies_diff"] == {
        "per_batch": {'1:b"1': {"total": 0, "locked": False, "per_sensor": {}}, '2:b"2': {"total": 2, "locked": True, "per_sensor": {"x": 1, "y": 1}},
                      '3:b"3': {"total": 3, "locked": False, "per_sensor": {"y": 2}}},
        "total_anomalies_range": {"min": 0, "max": 3, "abs_diff": 3}, "sensors_with_anomalies": ["x", "y"]}
    assert fragments.agg(F.max(F.length("text"))).first()[0] < 200  # no row holds the report
    with pytest.raises(ValueError):
        reports.comparison_fragments("r", "", *report_of(spark, 1))


def test_report_without_metrics_or_anomalies(spark, tmp_path):
    from batchgauge.sinks import reports

    summaries, metrics, counts = report_of(spark)
    reports.write_document(str(tmp_path / "doc"), reports.comparison_fragments("r", "t", summaries, metrics.limit(0), counts.limit(0)))
    found = json.loads(whole(tmp_path / "doc"))
    assert found["metrics_diff"]["per_metric"] == {} and found["anomalies_diff"]["sensors_with_anomalies"] == []


def test_wide_tables_of_many_columns(spark, tmp_path):
    from batchgauge.sinks import reports

    cells = spark.range(50_000).select(
        F.concat(F.lit("batch "), F.col("id").cast("string")).alias("batch_id"), F.lit("s").alias("sensor"), F.lit("max").alias("metric_name"),
        F.col("id").cast("double").alias("metric_value"))
    columns = spark.range(50_000).select(F.concat(F.lit("batch "), F.col("id").cast("string")).alias("name"), (F.col("id") * 3).alias("place"))
    blocks, index = reports.wide_blocks(cells, ["sensor", "metric_name"], "batch_id", "metric_value", columns)
    assert len(blocks.columns) == 3 + reports.BLOCK_COLUMNS
    reports.write_wide(str(tmp_path / "w"), blocks, index, ["sensor", "metric_name"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "w" / "blocks"))
    assert back.count() == -(-50_000 // reports.BLOCK_COLUMNS)
    names = spark.read.option("header", "true").csv(str(tmp_path / "w" / "index")).where("name = 'batch 777'").first()
    assert (names.block, names.slot) == ("3", "9")
    assert back.where("block = 3").first()["c9"] == "777.0"


def test_intermediates_are_dropped_on_request(spark):
    import os

    from batchgauge import session

    kept = dict(session._WRITTEN)  # tables that other tests may still read
    session._WRITTEN.clear()
    made = session.materialise(spark.range(5))
    path = session._WRITTEN[spark.sparkContext.applicationId][0]
    assert made.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert session.drop_intermediates(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    assert session.drop_intermediates(spark) == 0
    session._WRITTEN.update(kept)


def test_manifest_digests_a_configuration_once(spark):
    """Runs share configurations: their digests are stored beforehand, no row of a run goes through Python."""
    runs = spark.createDataFrame(
        [(i, 7, i, 2, 10, 1, None if i == 9 else '{"a": %d}' % (i % 2)) for i in range(10)],
        "run_id BIGINT, batch_id BIGINT, run_number BIGINT, config_version BIGINT, rows_processed BIGINT, rows_errors BIGINT, config_json STRING")
    batches = spark.createDataFrame([(7, "seven", "/d/x.csv")], "batch_id BIGINT, batch_name STRING, source_file STRING")
    metrics = spark.createDataFrame([(1, "s", "mean", 1.5)], "run_id BIGINT, sensor STRING, metric_name STRING, metric_value DOUBLE")
    anomalies = spark.createDataFrame([(1, "iqr (x)"), (1, "zscore"), (1, None)], "run_id BIGINT, anomaly_type STRING")
    errors = spark.createDataFrame([(2, "a"), (2, "a")], "run_id BIGINT, error_type STRING")
    manifest = snapshot_manifest(runs, batches, metrics, anomalies, errors)
    assert "EvalPython" not in manifest._jdf.queryExecution().optimizedPlan().toString()
    found = {r.run_id: r for r in manifest.collect()}
    digests = [hashlib.sha256(b'{"a": %d}' % i).hexdigest() for i in range(2)]
    assert [found[i].config_sha256 for i in range(10)] == [digests[i % 2] for i in range(9)] + [None]
    assert [(found[i].total_metrics, found[i].total_anomalies, found[i].total_errors) for i in range(4)] == [(0, 0, 0), (1, 3, 0), (0, 0, 2), (0, 0, 0)]
