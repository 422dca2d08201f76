"""Packing token sequences by minimum bin slack.

Every document is cut into full windows and a remainder. Remainders wait in a pool of bounded size;
a window is seeded with the longest of them, and a bitset over reachable sums (bit s is set when
some multiset of the remaining lengths adds up to s) finds the filling closest to capacity, read
back as counts per length. Slack that no multiset fills is closed by cutting one more remainder.
What is left at the end of a task, less than one window, is cut into windows of power-of-two length,
which take no padding.

Each task packs its own rows, so nothing is shuffled and a lost task repeats the same windows.
Null or empty text is the end id alone; repeated rows are packed like any others; an empty table
gives no row. A null ``doc_id`` is kept as null.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from batchgauge.llm.batches import arrow_schema, id_and_text, slices, texts
from batchgauge.llm.units import small_units, text_ids

WINDOW = 2048
POOL = 4096
"""Remainders a task holds at most; half of them stay to choose from until the task ends."""

PIECES = (
    "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"
)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length whose sum is the largest reachable one up to ``capacity``.

    Longer lengths are taken in first; the search ends as soon as the capacity itself is reachable.
    """
    mask, target = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, layers = 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        layers.append((length, reach))
        left, step = counts[length], 1
        while left and not reach & target:
            take = min(step, left)
            if length * take > capacity and take > 1:
                take = max(1, min(take, capacity // length))
                left = take
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach & target:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Windows of one task; ``rows`` collects finished pieces."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool: int = POOL):
        self.sequence, self.window, self.limit = first_sequence, window, pool
        self.pool: dict[int, list] = defaultdict(list)
        self.waiting = self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n - n % self.window, self.window):
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + self.window)], n)])
        if n % self.window:
            start = n - n % self.window
            self._put((doc_id, start, ids[4 * start :], n))
        if self.waiting >= self.limit:
            self._pack(self.limit // 2)

    def finish(self) -> None:
        self._pack(0)
        for power in reversed(range(self.window.bit_length())):
            if self.tokens >> power & 1:
                filling, room = [], 1 << power
                while room:
                    room = self._cut(min(self.pool), room, filling)
                self._emit(filling)

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pool[n].append(piece)
        self.waiting += 1
        self.tokens += n

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        self.tokens -= length
        return piece

    def _cut(self, length: int, room: int, filling: list) -> int:
        """Put a remainder, or the part of it that fits, into ``filling``; returns the room left."""
        doc_id, start, ids, total = self._take(length)
        if length > room:
            self._put((doc_id, start + room, ids[4 * room :], total))
            ids = ids[: 4 * room]
        filling.append((doc_id, start, ids, total))
        return room - len(ids) // 4

    def _pack(self, leave: int) -> None:
        while self.waiting > leave and self.tokens >= self.window:
            longest = max(self.pool)
            filling, room = [self._take(longest)], self.window - longest
            chosen = closest_fill({n: len(held) for n, held in self.pool.items()}, room)
            for length, n in chosen.items():
                filling += [self._take(length) for _ in range(n)]
                room -= length * n
            if room:
                self._cut(min(n for n in self.pool if n > room), room, filling)
            self._emit(filling)

    def _emit(self, filling: list) -> None:
        offset = 0
        for doc_id, start, ids, total in filling:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, pool: int = POOL, added_tokens: bool = False
) -> DataFrame:
    """Pieces of all documents with their window and place in it.

    ``added_tokens``: strings of the file's added tokens become their ids instead of ordinary text.
    """
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PIECES)
        packer = Packer(TaskContext.get().partitionId() << 40, window, pool)

        def drained() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * len(schema)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in slices(batches):
            ids = text_ids(tokenizer, texts(batch), small_units, added_tokens=added_tokens)
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids):
                packer.add(doc_id, found + end)
            yield drained()
        packer.finish()
        yield drained()

    return id_and_text(documents).mapInArrow(pieces, PIECES)
