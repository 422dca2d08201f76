"""One registered query per operator, each over its whole table, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from batchgauge.llm import (
    alignment, covertree, crosspolytope, dac, ecoc, licenses, packing, pii, prefixtrie, simhash, spellings, transducer,
    urls)
from batchgauge.session import share_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_OF_DOCUMENT = 2
END_OF_TEXT = 1


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op1_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query
def op2_pii(spark, sf):
    return pii.find(table(spark, sf, "documents"))


@query
def op3_addressable_codes(spark, sf):
    files = dac.write(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_OF_DOCUMENT,
        added_tokens=True)
    return dac.documents_of(files)


@query
def op4_url_filter(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@query
def op5_top_k(spark, sf):
    return covertree.top_k(table(spark, sf, "embeddings"))


@query
def op6_embedding_dedup(spark, sf):
    return crosspolytope.near_duplicates(table(spark, sf, "embeddings"))


@query
def op7_language_id(spark, sf):
    return ecoc.identify(table(spark, sf, "documents"))


@query
def op8_packing(spark, sf):
    return packing.pack_documents(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT, added_tokens=True)


@query
def op9_bpe_transducer(spark, sf):
    return transducer.encode_decode(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op11_token_alignment(spark, sf):
    return alignment.align(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN)


@query
def op12_prefix_trie(spark, sf):
    return prefixtrie.encode_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_spelling_variants(spark, sf):
    return spellings.variants(table(spark, sf, "documents"))


ORACLES["op5_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLES["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reached(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.seen
), component AS (
  SELECT vec_id, min(seen) AS component_id FROM reached GROUP BY vec_id
)
SELECT v.vec_id, count(l.b) AS n_links, any_value(c.component_id) AS component_id,
       v.vec_id = any_value(c.component_id) AS kept
FROM v JOIN component c USING (vec_id) LEFT JOIN links l ON l.a = v.vec_id
GROUP BY v.vec_id
"""
