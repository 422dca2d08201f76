"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from batchgauge.plans.catalogue import QUERIES
from batchgauge.plans.oracle import ORACLES

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
NAMES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def connected(tables):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def database():
    return connected(TABLES)


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    tables, connection = TABLES, database
    if name in ("cmp_anomalies_wide", "cmp_metrics_wide"):  # the smallest tables lack some columns of theirs
        tables, connection = LARGER, connected(LARGER)
    found = QUERIES[name](spark, tables)
    cursor = connection.execute(ORACLES[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(found.columns, [tuple(r) for r in found.collect()]) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
