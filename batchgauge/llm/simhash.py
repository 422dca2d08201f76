"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are computed once per document and grouped by value. Two fingerprints that differ in
at most three of 64 bits agree in one of four 16-bit blocks, so each distinct fingerprint is dealt
to four groups, by the first bits of each block, which finds every link. So many bits are taken that a
group holds some two thousand fingerprints, however many there are (one group for all, where there are
fewer). In a group, fingerprints are sorted by Gray rank: neighbours differ in few bits, and a run of them
shares most. Every node above them keeps the bits its run shares (mask and pattern), less those its
parent has; a search adds up the differences on the way down and drops whole runs once they exceed
the limit.

Groups far beyond that size (many fingerprints alike in a block, or more than a hundred million of them) are
cut into chunks, and pairs of chunks meet in tasks of their own. Tasks return a spanning forest of the
links they find, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, per_slice, texts
from batchgauge.llm.components import components
from batchgauge.operators.slicing import stored_small
from batchgauge.session import materialise

SEED = 42
SHINGLE_WORDS = 3
MOST_DIFFERENCES = 3
BLOCK_BITS = 16
LEAF = 4
"""Fingerprints below one leaf of the index, and children below one inner node."""
GROUP = 2048
"""Fingerprints a group holds on average, about; one of four times as many is cut."""
AT_ONCE = 512
"""Queries that go down the index together."""
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text's 3-word shingles; 0 without words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()  # blanks: space and \\t to \\r
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        words = [b" ".join(words), b"", b""]
        shingles = words[:1]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), 8192):
        some = shingles[at : at + 8192]
        hashes = np.array([digest(s, SEED) for s in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    chosen = np.packbits(2 * counts > len(shingles), bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long; one row per row. Null text: no words."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        found = np.array([fingerprint(t) for t in texts(batch)], "<u8").view("<i8")
        return [batch.column("doc_id").to_pylist(), found.tolist()]

    return per_slice(id_and_text(documents), "doc_id BIGINT, fp BIGINT", rows)


# --- the index ----------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray sequence of its width."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchy over ``values`` (unsigned 64 bit) in Gray order."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        mask, pattern = np.full(len(values), ~np.uint64(0)), self.values
        levels = []
        while len(levels) == 0 or len(mask) > LEAF:
            starts = np.arange(0, len(mask), LEAF)
            shared = np.bitwise_and.reduceat(mask, starts)
            ones, any_one = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = shared & ~(ones ^ any_one)
            pattern = ones & mask
            levels.append([mask, pattern])
        # From the top: each node keeps the shared bits that its parent has not counted yet.
        self.levels = levels[::-1]
        above = None
        for i, (mask, pattern) in enumerate(self.levels):
            own = mask if above is None else mask & ~np.repeat(above, LEAF)[: len(mask)]
            above = mask
            self.levels[i] = own, pattern & own
        self.leaf_own = ~np.repeat(above, LEAF)[: len(values)]
        self.compared = 0
        """Pairs whose difference was taken in full; searches leave out the others."""

    def search(self, queries: np.ndarray, most: int = MOST_DIFFERENCES) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``values`` as given) that differ in at most ``most`` bits."""
        found_q, found_v = [], []
        for at in range(0, len(queries), AT_ONCE):
            some = queries[at : at + AT_ONCE]
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(some)), top), np.tile(np.arange(top), len(some))
            so_far = np.zeros(len(q), np.uint8)
            for depth, (own, pattern) in enumerate(self.levels):
                if depth:
                    q, node, so_far = self._below(q, node, so_far, len(own))
                so_far = so_far + np.bitwise_count((some[q] ^ pattern[node]) & own[node])
                stay = so_far <= most
                q, node, so_far = q[stay], node[stay], so_far[stay]
            q, node, so_far = self._below(q, node, so_far, len(self.values))
            self.compared += len(q)
            near = so_far + np.bitwise_count((some[q] ^ self.values[node]) & self.leaf_own[node]) <= most
            found_q.append(q[near] + at)
            found_v.append(self.order[node[near]])
        return np.concatenate(found_q), np.concatenate(found_v)

    @staticmethod
    def _below(q: np.ndarray, node: np.ndarray, so_far: np.ndarray, size: int):
        children = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        inside = children < size
        return np.repeat(q, LEAF)[inside], children[inside], np.repeat(so_far, LEAF)[inside]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per item the smallest item linked with it, directly or not."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def group_edges(values: np.ndarray, chunk: np.ndarray, pair: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one group, or between its two chunks."""
    if pair:
        first = np.flatnonzero(chunk == chunk.min())
        second = np.flatnonzero(chunk != chunk.min())
        if not len(second):
            return values[:0], values[:0]
        q, v = GrayIndex(values[first]).search(values[second])
        left, right = second[q], first[v]
    else:
        left, right = GrayIndex(values).search(values)
    label = forest(len(values), left, right)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


# --- Spark --------------------------------------------------------------------------


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` linked with each other."""
    bits = max(0, min(BLOCK_BITS, math.ceil(math.log2(max(1, fps.count()) / group))))
    # without any bits the groups of all blocks would be the same
    blocks = F.array(*[
        F.shiftrightunsigned(F.col("fp"), BLOCK_BITS * (i + 1) - bits).bitwiseAND((1 << bits) - 1) + F.lit(i << BLOCK_BITS)
        for i in range(64 // BLOCK_BITS if bits else 1)
    ])
    keyed = fps.select("fp", F.explode(blocks).alias("key"))
    sizes = stored_small(keyed.groupBy("key").count().where("count > 1"))
    met = keyed.join(sizes, "key").withColumn(
        "chunks", F.when(F.col("count") > 4 * group, F.ceil(F.col("count") / (2 * group))).otherwise(1).cast("long"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = met.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select(
        "key", "fp", "chunk",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
    )
    return (
        met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_edges_of_runs, "a BIGINT, b BIGINT").distinct()
    )


def _edges_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of every run of equal (key, low, high); a run is a group or two chunks of one."""
    schema, held = arrow_schema("a BIGINT, b BIGINT"), None

    def edges(run: np.ndarray) -> pa.RecordBatch:
        ids = run["key"] << 40 | run["low"] << 20 | run["high"]
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        sizes = np.diff(starts, append=len(ids))
        found = [(run["fp"][:0], run["fp"][:0])]
        for start, size in zip(starts.tolist(), sizes.tolist()):
            if size > 1:
                part = {c: run[c][start : start + size] for c in run}
                found.append(group_edges(part["fp"], part["chunk"], part["low"][0] != part["high"][0]))
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high", "chunk", "fp")}
        new = {c: v.astype(np.int64) for c, v in new.items()}
        new["fp"] = new["fp"].view(np.uint64)
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        last = (held["key"] == held["key"][-1]) & (held["low"] == held["low"][-1]) & (held["high"] == held["high"][-1])
        cut = int(np.argmax(last))
        if cut:
            yield edges({c: v[:cut] for c, v in held.items()})
            held = {c: v[cut:] for c, v in held.items()}
    if held is not None:
        yield edges(held)


def near_duplicates(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for every row.

    Documents are linked at three or fewer differing bits; the component is the smallest
    ``doc_id`` reachable (null where no document reached has one). Documents without words have
    fingerprint 0 and are linked like any other. An empty table gives no row.
    """
    prints = materialise(fingerprints(documents))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("fp"), group))
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
