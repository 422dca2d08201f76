"""A training-data pipeline: language ID, near-duplicate removal, personal data, packing.

Each stage takes the documents its predecessor kept and calls one operator of ``batchgauge.llm``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchgauge.llm import ecoc, packing, pii, simhash
from batchgauge.llm.queries import END_OF_TEXT, table
from batchgauge.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: null texts and texts without a letter. Every row is
    judged by its own text; where the table has no labels to learn from, no other document goes."""
    return ecoc.determined(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays: the smallest ``doc_id`` (rows without id come last), of equal
    ids the smallest text digest. Documents are rows, told apart by a key that is stored with them, so
    different texts that share an id do not take each other along."""
    rows = materialise(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")))
    found = simhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    groups = materialise(found.select(F.col("doc_id").alias("member"), "component_id"))
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component_id").alias("component"))
    members = groups.join(several, groups["component_id"] == several["component"], "left_semi")
    rank = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.sha2(F.col("row.text").cast("string"), 256), F.col("key"))
    ranked = materialise(rows.select("key", rank.alias("rank")).join(members, F.col("key") == F.col("member")))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias("first"))
    gone = materialise(ranked.join(first, F.col("key") == F.col("first"), "left_anti").select("member"))
    return rows.join(gone, F.col("key") == F.col("member"), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows. Null texts stay null, every
    row comes out, repeated ones too; an empty table gives no rows."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens. A null text is an empty one and has its
    end token alone, repeated rows are packed as often as they come; an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT, added_tokens=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # fingerprints, learned models and tokenizers have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return materialise(STAGES[-1][1](spark, docs, sf_dir))
