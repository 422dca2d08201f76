"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
nearest vertex of the cross-polytope, the coordinate of largest magnitude with its sign. A table
joins ``FUNCTIONS`` such hashes. Besides its own bucket a vector enters those that replace the hash
with the closest runner-up (multiprobe). Vectors that share a bucket are verified by cosine.

Identical vectors are one class and are hashed once. A pair of classes is counted in the first
bucket they share, which each task works out from the vectors, so tables need no list of pairs:
tasks return the number of links per class and a spanning forest. Buckets beyond ``CHUNK`` vectors
are cut into chunks, and pairs of chunks meet in tasks of their own. More vectors need a third hash
per table (from some ten million on); then ten tables find the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema
from batchgauge.llm.components import components
from batchgauge.llm.simhash import forest
from batchgauge.session import materialise

COSINE = 0.95
TABLES = 6
FUNCTIONS = 2
PROBES = 2
"""Buckets entered per table beside the own one; one per hash at most."""
CHUNK = 1024
PAIRS_AT_ONCE = 50_000


def usable(vector: Column) -> Column:
    """True for vectors that can link: not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return x


def bucket_codes(vectors: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> np.ndarray:
    """Codes of shape (rows, tables, 1 + probes); the table is part of the code.

    They depend on a row alone, whatever rows are hashed with it.
    """
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors / np.abs(vectors).max(1, keepdims=True)
    rng, out = np.random.default_rng(20_000 + d), []
    vertices = 2 * width
    for table in range(tables):
        own, other, gap = [], [], []
        for _ in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
            two = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            value = np.take_along_axis(y, two, 1)
            vertex = two * 2 + (value < 0)
            own.append(vertex[:, 0])
            other.append(vertex[:, 1])
            gap.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
        places = vertices ** np.arange(functions)
        code = table * vertices**functions + np.stack(own, 1) @ places
        change = (np.stack(other, 1) - np.stack(own, 1)) * places
        closest = np.argsort(np.stack(gap, 1), axis=1, kind="stable")[:, :probes]
        out.append(np.concatenate([code[:, None], code[:, None] + np.take_along_axis(change, closest, 1)], 1))
    return np.stack(out, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield batch.filter(pa.array(lengths == length))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every class with its bucket keys (dimension and code, packed)."""
    for whole in batches:
        for batch in _by_length(whole, "vector") if whole.num_rows else ():
            x = matrix(batch.column("vector"))
            codes = bucket_codes(x).reshape(len(x), -1) | (x.shape[1] << 40)
            keys = pa.array(list(codes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("vector"), keys],
                                             names=["id", "copies", "vector", "keys"])


def _first_shared(x: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether ``keys[p]`` is the smallest code that rows ``i[p]`` and ``j[p]`` share."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    codes = bucket_codes(x[used])
    i, j = place[: len(i)], place[len(i) :]
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        some = slice(at, at + PAIRS_AT_ONCE)
        a, b = codes[i[some]], codes[j[some]]
        same = (a[:, :, :, None] == b[:, :, None, :]).any(3)
        out[some] = np.where(same, a, np.iinfo(np.int64).max).min((1, 2)) == keys[some]
    return out


def _near_pairs(unit: np.ndarray, side: np.ndarray, pair: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with at least the cosine; with ``pair`` only those across the two sides."""
    rows = np.arange(len(unit))
    first, second = (rows[side == side.min()], rows[side != side.min()]) if pair else (rows, rows)
    for at in range(0, len(first), 256):
        a, b = np.nonzero(unit[first[at : at + 256]] @ unit[second].T >= cosine)
        i, j = first[a + at], second[b]
        yield (i, j) if pair else (i[i < j], j[i < j])


def bucket_links(x: np.ndarray, copies: np.ndarray, side: np.ndarray, starts: np.ndarray, keys: np.ndarray, pair: np.ndarray, cosine: float):
    """Links of many buckets, which begin at ``starts``: how many each row gets from the buckets that
    are the first to find them, and a forest label per row."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    counts, labels = np.zeros(len(x), np.int64), np.arange(len(x))
    held: list[tuple] = []

    def settle() -> None:
        nonlocal labels
        i, j, of = (np.concatenate(c) for c in zip(*held))
        held.clear()
        own = _first_shared(x, i, j, of)
        i, j = i[own], j[own]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        rows = np.arange(len(x))  # earlier links enter as pairs of a row and its label
        labels = forest(len(x), np.concatenate([i, rows]), np.concatenate([j, labels]))

    waiting = 0
    for start, end, key, two in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], keys.tolist(), pair.tolist()):
        if end - start > 1:
            for i, j in _near_pairs(unit[start:end], side[start:end], two, cosine):
                if len(i):
                    held.append((i + start, j + start, np.full(len(i), key)))
                    waiting += len(i)
            if waiting > 500_000:
                settle()
                waiting = 0
    if held:
        settle()
    return counts, labels


def _linked(cosine: float):
    ddl = "a BIGINT, b BIGINT, n BIGINT"

    def answer(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
        key, low, high = (part.column(c).to_numpy() for c in ("key", "low", "high"))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        starts = np.flatnonzero(new)
        counts, labels = bucket_links(
            matrix(part.column("vector")), copies, part.column("side").to_numpy(), starts,
            key[starts] & ((1 << 40) - 1), low[starts] != high[starts], cosine)
        some, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(ids)))
        a = pa.array(np.concatenate([ids[some], ids[moved]]))
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[labels[moved]]]),
                     mask=np.arange(len(some) + len(moved)) < len(some))
        n = pa.array(np.concatenate([counts[some], np.zeros(len(moved), np.int64)]))
        return pa.RecordBatch.from_arrays([a, b, n], schema=arrow_schema(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets are runs of equal (key, low, high), of two chunks at most; the last run of a batch
        waits for the next batch."""
        held = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key, low, high = (whole.column(c).to_numpy() for c in ("key", "low", "high"))
            cut = int(np.argmax((key == key[-1]) & (low == low[-1]) & (high == high[-1])))
            if cut:
                yield from map(answer, _by_length(whole.slice(0, cut), "vector"))
            held = whole.slice(cut)
        if held is not None:
            yield from map(answer, _by_length(held, "vector"))

    return run, ddl


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Unusable vectors and rows without ``vec_id`` link with nothing and are components of their own
    (``kept`` is true; the component of a null id is null). Rows that share a ``vec_id`` are one
    node of the components; each counts its own links. Vectors of different lengths never link. Empty in,
    empty out.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fit = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # equal vectors are one class; its number is stored with it, so it stays the same
    classes = materialise(fit.groupBy("vector").agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    members = materialise(fit.join(classes.select("vector", "id"), "vector").select("vec_id", "id"))
    kind = classes.schema["vector"].dataType.simpleString()
    keyed = classes.select("id", "copies", "vector").mapInArrow(_coded, f"id BIGINT, copies BIGINT, vector {kind}, keys ARRAY<BIGINT>")
    keyed = materialise(keyed.select("id", "copies", "vector", F.explode(F.array_distinct("keys")).alias("key")))
    # Keys of one vector are of no use; the others' sizes say how a bucket is cut.
    sizes = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("count") / chunk))
    met = met.withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
                     "side", "id", "copies", "vector")
    run, ddl = _linked(cosine)
    found = materialise(met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, ddl))
    several = members.groupBy("vec_id").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b < last").select("vec_id", "b")
    shared = members.join(several, "vec_id").select(F.col("id").alias("a"), "b")
    linked = components(found.where("b IS NOT NULL").select("a", "b").union(shared)).select(F.col("node").alias("id"), "component")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    firsts = members.groupBy("id").agg(F.min("vec_id").alias("first"))
    named = materialise(firsts.join(classes.select("id", "copies"), "id").join(counts, "id", "left").join(linked, "id", "left").select(
        "id", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked_rows = members.join(named.join(least, "component"), "id").select("vec_id", "n_links", "component_id")
    others = rows.where(~(usable(F.col("vector")) & F.col("vec_id").isNotNull()))
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
