"""What the operators share: texts of Arrow batches and task-side helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256
"""Rows turned into Python objects at a time, so that a batch of long texts stays small."""

ROWS_OF_SHORT_TEXTS, SHORT_TEXTS_BYTES = 2048, 16 << 20
"""Rows taken together where they hold no more bytes, so that units of many texts are looked up once."""


def id_and_text(documents: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` alone; other columns, whatever their names, are not read."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def long_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longer slices where texts are short; else as :func:`slices`."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_OF_SHORT_TEXTS):
            part = batch.slice(start, ROWS_OF_SHORT_TEXTS)
            yield from [part] if part.nbytes <= SHORT_TEXTS_BYTES else slices([part])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


_ARROW = {
    "BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_(), "STRING": pa.string(),
    "BINARY": pa.binary(), "ARRAY<BIGINT>": pa.list_(pa.int64()), "ARRAY<INT>": pa.list_(pa.int32()),
    "ARRAY<STRING>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name TYPE, name TYPE``; tasks have no session that could parse it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (column.split() for column in ddl.split(","))])


def per_slice(df: DataFrame, ddl: str, rows: Callable[[pa.RecordBatch], list[list]], cut=slices) -> DataFrame:
    """Map slices of a partition to columns of ``ddl``; ``rows`` returns one list per column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for part in cut(batches):
            columns = rows(part)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)
