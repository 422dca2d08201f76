"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k the
k-th chunk of the ids that have one. A bitmap per level says which ids go on, and a rank directory
over the bitmap says where on the next level: any id is found with one step per chunk, without
decoding what stands before it.

Files are Parquet, one row per block of whole documents: Spark commits them, so a lost executor
leaves no half-written file. Blocks are in ascending ``doc_id`` order (null first, repeated ids in
input order). A null or empty text is a document of the end id alone; an empty table gives no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, long_slices, texts
from batchgauge.llm.units import byte_level_text_ids, forget
from batchgauge.session import materialise

MAGIC = b"DAC1"
CHUNK_BITS = 8
SUPERBLOCK = 512
"""Bits of a bitmap per entry of its rank directory."""
BLOCK_TOKENS = 1 << 20
"""A block is closed at this many ids; a longer document has a block of its own."""
MEMO_BYTES = 256 << 20
"""Units that a writing worker remembers: words keep their case here, and nothing else is held but a block."""

BLOCKS = (
    "part INT, block INT, part_start BIGINT, tokens BIGINT, doc_ids ARRAY<BIGINT>, lengths ARRAY<BIGINT>, payload BINARY"
)


def pack(ids: np.ndarray) -> bytes:
    """The codes of an array of unsigned integers."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        whole = np.zeros(-(-len(rest) // SUPERBLOCK) * (SUPERBLOCK // 8), np.uint8)
        whole[: len(bitmap)] = bitmap
        ranks = np.bitwise_count(whole.reshape(-1, SUPERBLOCK // 8)).sum(1, dtype=np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ranks, dtype=np.uint32)])
        out += [struct.pack("<I", len(rest)), directory.tobytes(), whole.tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        rest = more[goes_on]
        if not len(rest):
            return MAGIC + struct.pack("<I", len(out) // 4) + b"".join(out)


class Codes:
    """Reader of :func:`pack`'s bytes: ``codes[i]``, ``codes.take(positions)``, ``codes.all()``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (depth,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(depth):
            (n,) = struct.unpack_from("<I", data, at)
            blocks = -(-n // SUPERBLOCK)
            directory = np.frombuffer(data, "<u4", blocks + 1, at + 4)
            at += 4 + 4 * (blocks + 1)
            bitmap = np.frombuffer(data, np.uint8, blocks * (SUPERBLOCK // 8), at)
            at += len(bitmap)
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            self.levels.append((n, directory, bitmap, chunks))

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return int(self.take(np.array([i]))[0])

    def take(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, in time that depends on their number alone."""
        at, found = positions.astype(np.int64), np.zeros(len(positions), np.uint32)
        alive = np.arange(len(positions))
        for level, (_, directory, bitmap, chunks) in enumerate(self.levels):
            found[alive] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            goes_on = (bitmap[byte] >> bit) & 1 == 1
            alive, at, byte, bit = alive[goes_on], at[goes_on], byte[goes_on], bit[goes_on]
            if not len(alive):
                break
            start = at // SUPERBLOCK
            words = bitmap.reshape(-1, SUPERBLOCK // 8)[start]
            column = np.arange(SUPERBLOCK // 8)
            offset = (byte - start * (SUPERBLOCK // 8))[:, None]
            before = np.where(column < offset, 255, np.where(column == offset, ((1 << bit.astype(np.int64)) - 1)[:, None], 0))
            at = directory[start].astype(np.int64) + np.bitwise_count(words & before.astype(np.uint8)).sum(1, dtype=np.int64)
        return found

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        below = np.zeros(0, np.uint32)
        for n, _, bitmap, chunks in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=n, bitorder="little").view(bool)
            ids[goes_on] |= below << np.uint32(CHUNK_BITS)
            below = ids
        return below


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, pattern: str, added_tokens: bool) -> Iterator[tuple[int | None, bytes]]:
    """The ``doc_id`` and ids of every row; units of a slice are looked up together."""
    for batch in long_slices(batches):
        found = byte_level_text_ids(tokenizer, texts(batch), pattern, added_tokens, MEMO_BYTES)
        yield from zip(batch.column("doc_id").to_pylist(), found)


def write(documents: DataFrame, tokenizer: str, pattern: str, end_id: int, added_tokens: bool = False) -> DataFrame:
    """Encode ``documents`` with a byte-level tokenizers file and return the written blocks.

    ``tokenizer`` and ``pattern`` are the file and its split pattern. Texts are shuffled once, by
    range of ``doc_id``; rows of one ``doc_id`` may be cut anywhere, by their place in the input.
    ``added_tokens``: strings of the file's added tokens become their ids instead of ordinary text.
    """
    end = struct.pack("<I", end_id)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(BLOCKS)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"))
            row = [part, block, before, size, doc_ids, lengths, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        for doc_id, found in encoded(batches, tokenizer, pattern, added_tokens):
            doc_ids.append(doc_id)
            lengths.append(len(found) // 4 + 1)
            held += [found, end]
            size += lengths[-1]
            if size >= BLOCK_TOKENS:
                yield close()
                block, before = block + 1, before + size
                doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield close()

    placed = id_and_text(documents).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    return materialise(ordered.select("doc_id", "text").mapInArrow(blocks, BLOCKS))


def with_starts(files: DataFrame) -> DataFrame:
    """Blocks with ``start``, the ids of all blocks before them.

    Only one row per part goes through the window; a part is a partition of the writing job.
    """
    totals = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_total"))
    return files.join(F.broadcast(starts), "part").withColumn("start", F.col("part_total") + F.col("part_start"))


def documents_of(files: DataFrame) -> DataFrame:
    """Per document, from the files: place, number and checksum of its ids."""
    ddl = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker may be one that wrote blocks
        schema = arrow_schema(ddl)
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, payload = (batch.column(c)[i] for c in ("start", "doc_ids", "lengths", "payload"))
                data = memoryview(Codes(payload.as_py()).all().astype("<u4").tobytes())
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                sums = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                arrays = [pa.array(doc_ids.as_py(), pa.int64()), pa.array(start.as_py() + ends - n), pa.array(n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return with_starts(files).select("start", "doc_ids", "lengths", "payload").mapInArrow(rows, ddl)


def tokens_at(files: DataFrame, wanted: DataFrame, per_task: int = 16) -> DataFrame:
    """Random access: ``wanted`` holds global ``position``; returns ``position`` and ``id``.

    Positions meet their block by a range join on block numbers of ``BLOCK_TOKENS`` ids, so each
    block is read once and only the asked ids are decoded. Positions outside the files give no row.
    """
    cells = with_starts(files).select(
        "start", "tokens", "payload",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK_TOKENS), F.floor((F.col("start") + F.col("tokens") - 1) / BLOCK_TOKENS))).alias("cell"),
    )
    asked = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("position") / BLOCK_TOKENS))
    near = asked.join(cells.select("cell", "start", "tokens"), "cell").where("position >= start AND position < start + tokens")
    lists = near.groupBy("start", F.floor(F.col("position") / (BLOCK_TOKENS // per_task)).alias("slot")).agg(
        F.collect_list("position").alias("positions"))  # at most BLOCK_TOKENS / per_task positions each
    ddl = "position BIGINT, id BIGINT"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked_here = np.array(batch.column("positions")[i].as_py(), np.int64)
                ids = Codes(batch.column("payload")[i].as_py()).take(asked_here - batch.column("start")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(asked_here), pa.array(ids.astype(np.int64))], schema=arrow_schema(ddl))

    return lists.join(with_starts(files).select("start", "payload"), "start").select("start", "positions", "payload").mapInArrow(rows, ddl)
