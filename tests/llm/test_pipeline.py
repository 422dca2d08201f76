"""The pipeline against its stages done by hand, and the registered queries."""

import os

import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from batchgauge.llm import packing, pii, queries, simhash
from cases import TEXTS, documents

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"Number {i} of several english texts with words of its own {i * 7919} and mail x{i}@y.org", "en", "s", 1) for i in range(20)]
    rows += [rows[5], (None, "no id here", "en", "s", 10)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    with_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(r.text for r in kept.collect()) == sorted(r[1] for r in with_letters)
    single = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    assert single.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    ids = sorted(r.doc_id for r in single.collect() if r.doc_id is not None)
    assert ids == sorted({c for i, c in groups.items() if i is not None})
    assert single.where("doc_id IS NULL").count() == 1
    clean = corpus_pipeline.personal_data(spark, single, str(tmp_path))
    assert clean.columns == docs.columns
    assert not any(pii.base_spans(r.text) for r in clean.collect())
    assert clean.count() == single.count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in clean.collect()}
    assert whole.columns == packing.pack_documents(clean, P.path("word_bpe_49k.json"), 1).columns


def test_rows_that_share_an_id_do_not_decide_about_each_other(spark, tmp_path):
    """Null, letterless and different texts under one id; no labels anywhere."""
    rows = [(3, "...", None, "s", 3), (3, "A clean text about rivers and the towns on their banks", None, "s", 1), (3, None, None, "s", 0),
            (4, "Bread is made of flour, water, salt and some patience", None, "s", 1),
            (4, "The committee will meet again when the report is printed", None, "s", 1),
            (5, "Bread is made of flour, water, salt and some patience", None, "s", 1),
            (None, "Bread is made of flour, water, salt and some patience", None, "s", 1), (6, "\u00b2 \u00bd", None, "s", 3)]
    docs = documents(spark, rows)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    letters = sorted(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == letters
    single = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    assert single.columns == docs.columns
    assert sorted((r.doc_id, r.text[:5]) for r in single.collect()) == [(3, "A cle"), (4, "Bread"), (4, "The c")]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    found = queries.QUERIES[name](spark, TABLES)
    cursor = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op13_spelling_variants"}))  # that one is about words
def test_query_returns_whole_tables(spark, name):
    found = queries.QUERIES[name](spark, TABLES)
    key = found.columns[0]
    source = "pages" if key == "page_id" else "documents"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{TABLES}/{source}.parquet").count()
