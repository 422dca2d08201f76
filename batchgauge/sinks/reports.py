"""Comparison reports over any number of batches: one JSON document, and wide tables in column blocks.

Neither needs a row, a plan or a driver that grows with the report. The document is written as ordered
fragments, one line each, whose concatenation is a single JSON object; wide tables are cut into blocks of
a fixed number of columns, with an index that says which batch stands where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.compare import matrix_summary, metric_matrix
from batchgauge.operators.slicing import stored_small, with_numbers
from batchgauge.session import materialise

ORDER = ["section", "metric", "batch", "step", "value_batch", "sensor"]
"""The place of a fragment; NULLs come first."""


def quoted(value: Column) -> Column:
    """A value as JSON, NULL as null; infinities and NaN as text."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _object(**fields: Column | str) -> list[Column]:
    """``"name":value`` pieces of an object, joined by commas."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(f'{"," if i else ""}"{name}":'), value if isinstance(value, Column) else F.lit(value)]
    return parts


def _comma(first: Column) -> Column:
    return F.when(first, "").otherwise(",")


def comparison_fragments(
    name: str, generated_at: str, summaries: DataFrame, metrics: DataFrame, counts: DataFrame,
    scheme: tuple[int, str, str] | None = None,
) -> DataFrame:
    """The report as fragments: the columns of ``ORDER`` and ``text``.

    ``summaries``: one row per batch with ``batch_id, batch_name, locked`` (``compare.batch_summaries``);
    ``metrics``: ``batch_id, sensor, metric_name, metric_value``; ``counts``: ``batch_id, sensor,
    anomalies`` with the total where ``sensor`` is NULL (``anomaly.anomaly_counts``); ``scheme``: id, name,
    version. Batches are named ``id:name`` and metrics ``sensor::metric``; a metric lists the batches that
    have it.
    """
    summaries = materialise(summaries)
    if summaries.limit(2).count() < 2:
        raise ValueError("a comparison needs at least 2 batches")
    label = F.concat_ws(":", F.col("batch_id").cast("string"), "batch_name")
    batches = summaries.select("batch_id", label.alias("label"), "locked")
    kind = summaries.schema["batch_id"].dataType
    values = materialise(metrics.join(batches, "batch_id").select(
        "batch_id", "label", F.concat_ws("::", "sensor", "metric_name").alias("metric"), "sensor", "metric_name", "metric_value"))
    matrix = metric_matrix(values)
    keyed = materialise(matrix.withColumn("metric", F.concat_ws("::", "sensor", "metric_name")).join(
        values.groupBy("metric").agg(F.min("batch_id").alias("first_batch")), "metric"))
    counts = materialise(counts.join(batches, "batch_id"))
    per_sensor = counts.where("sensor IS NOT NULL AND anomalies > 0")
    totals = batches.join(counts.where("sensor IS NULL").select("batch_id", "anomalies"), "batch_id", "left").fillna(0, ["anomalies"])
    opening = per_sensor.groupBy("batch_id").agg(F.min("sensor").alias("first_sensor"))

    first_batch = F.lit(summaries.agg(F.min("batch_id")).first()[0])
    first_metric = F.lit(keyed.agg(F.min("metric")).first()[0])
    first_sensor = F.lit(per_sensor.agg(F.min("sensor")).first()[0])
    compared = matrix_summary(matrix).first()
    least, most = totals.agg(F.min("anomalies"), F.max("anomalies")).first()

    def rows(source: DataFrame, section: int, *text: Column | str, **place) -> DataFrame:
        at = {"section": F.lit(section), "metric": F.lit(None).cast("string"), "batch": F.lit(None).cast(kind), "step": F.lit(0),
              "value_batch": F.lit(None).cast(kind), "sensor": F.lit(None).cast("string")} | place
        return source.select(*[at[c].alias(c) for c in ORDER], F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("text"))

    one = summaries.sparkSession.range(1)
    scheme_id, scheme_name, scheme_version = scheme or (None, None, None)
    fixed = _object(
        id=quoted(F.lit(scheme_id).cast("bigint")), name=quoted(F.lit(scheme_name).cast("string")),
        version=quoted(F.lit(scheme_version).cast("string")))
    by_batch, by_metric = F.col("batch_id"), F.col("metric")
    parts = [
        rows(one, 0, '{"name":', quoted(F.lit(name)), ',"scheme":{', *fixed, '},"generated_at":', quoted(F.lit(generated_at)), ',"batch_summaries":['),
        rows(summaries, 1, _comma(by_batch == first_batch), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), batch=by_batch),
        rows(one, 2, f'],"metrics_diff":{{"summary":{{"total_metrics_compared":{compared[0]},"metrics_with_diff":{compared[1]},"batch_keys":['),
        rows(batches, 3, _comma(by_batch == first_batch), quoted(F.col("label")), batch=by_batch),
        rows(one, 4, ']},"per_metric":{'),
        rows(keyed, 5, _comma(by_metric == first_metric), quoted(by_metric), ":{", *_object(
            sensor=quoted(F.col("sensor")), metric=quoted(F.col("metric_name")), values="{"), metric=by_metric),
        rows(values.join(keyed.select("metric", "first_batch"), "metric"), 5, _comma(by_batch == F.col("first_batch")),
             quoted(F.col("label")), ":", quoted(F.col("metric_value")), metric=by_metric, step=F.lit(1), value_batch=by_batch),
        rows(keyed, 5, "},", *_object(abs_diff=quoted(F.col("abs_diff")), rel_diff_pct=quoted(F.col("rel_diff_pct"))), "}",
             metric=by_metric, step=F.lit(2)),
        rows(one, 6, '}},"anomalies_diff":{"per_batch":{'),
        rows(totals, 7, _comma(by_batch == first_batch), quoted(F.col("label")), ":{", *_object(
            total=quoted(F.col("anomalies")), locked=quoted(F.col("locked")), per_sensor="{"), batch=by_batch),
        rows(per_sensor.join(opening, "batch_id"), 7, _comma(F.col("sensor") == F.col("first_sensor")), quoted(F.col("sensor")), ":",
             quoted(F.col("anomalies")), batch=by_batch, step=F.lit(1), sensor=F.col("sensor")),
        rows(batches, 7, "}}", batch=by_batch, step=F.lit(2)),
        rows(one, 8, f'}},"total_anomalies_range":{{"min":{least},"max":{most},"abs_diff":{most - least}}},"sensors_with_anomalies":['),
        rows(per_sensor.select("sensor").distinct(), 9, _comma(F.col("sensor") == first_sensor), quoted(F.col("sensor")), sensor=F.col("sensor")),
        rows(one, 10, "]}}"),
    ]
    document = parts[0]
    for part in parts[1:]:
        document = document.unionByName(part)
    return document


def write_document(path: str, fragments: DataFrame) -> str:
    """The fragments in order, a line each: the files of the folder in order of their names are one JSON object."""
    fragments.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]).select("text").write.mode("error").text(path)
    return path


# --- wide tables --------------------------------------------------------------------

BLOCK_COLUMNS = 256
"""Value columns of a block."""


def wide_blocks(
    cells: DataFrame, keys: list[str], column: str, value: str, columns: DataFrame, width: int = BLOCK_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """A wide table as blocks of ``width`` value columns, and its index.

    ``cells``: one row per key and column; ``columns``: the declared columns, ``name`` and their numeric
    ``place`` in the table. The blocks have the columns ``block``, ``keys`` and ``c0, c1, ...``; the index
    says which column of which block a name became: ``block, slot, name``. A key is in the blocks it has a
    cell in. No list of names reaches the driver or a plan, whatever their number.
    """
    numbered = with_numbers(columns.select(F.col("name"), F.col("place")), "place", "place")
    index = materialise(numbered.select(
        F.floor((F.col("pos") - 1) / width).cast("int").alias("block"), ((F.col("pos") - 1) % width).cast("int").alias("slot"), "name"))
    placed = cells.join(stored_small(index.withColumnRenamed("name", "_name")), F.col(column) == F.col("_name"))
    blocks = placed.groupBy("block", *keys).agg(*[
        F.max(F.when(F.col("slot") == i, F.col(value))).alias(f"c{i}") for i in range(width)])
    return blocks, index


def write_wide(path: str, blocks: DataFrame, index: DataFrame, keys: list[str]) -> str:
    """CSV with a folder for every block, rows in order of the keys, and the folder ``index``."""
    (
        blocks.repartitionByRange("block", *keys).sortWithinPartitions("block", *keys)
        .write.mode("error").partitionBy("block").option("header", "true").csv(f"{path}/blocks")
    )
    index.repartitionByRange("block", "slot").sortWithinPartitions("block", "slot").write.mode("error").option("header", "true").csv(f"{path}/index")
    return path
