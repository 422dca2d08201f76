"""Spelling variants: words one edit apart, found by dense comparison of code-point matrices.

Words stand as rows of padded matrices, once from their first character on and once from their last.
Two blocks of rows are compared as a whole: the common prefixes and common suffixes of all pairs come
from the matrices at once, and a pair whose two lengths reach the longer word's length minus one is a
single edit, whatever its kind.

Which blocks meet: the longer word of a pair, of length m, is parted into ``PARTS`` segments. The edit
lies in one of them; what is before and behind it is the same in both words. So every word stands, for
each segment and as longer or shorter word, in the group of words that share those characters, and
only blocks of a group are compared. A pair counts in the group of the segment that its common prefix
ends in, so it counts once. Groups of many words are cut into blocks whose pairs meet in tasks of their
own; small groups are compared several at a time.

A word has at most about (2 * length + 1) * 90 neighbours, one for each edit and letter, so no word
gathers a number of links that grows with the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, slices
from batchgauge.session import materialise

PARTS = 3
"""Segments of a word; more of them make smaller groups and more rows."""
BLOCK_CELLS = 1 << 16
"""Code points in a block of a large group."""
TILE_CELLS = 1 << 20
"""Cells (pairs times code points) compared in one step."""
TOGETHER = 48
"""Rows of small groups compared in one step."""
HELD = 300_000
"""Words whose counts or neighbours a task holds before it passes them on."""


# --- words of documents ------------------------------------------------------------


def _runs(least: int) -> re.Pattern[bytes]:
    return re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)


def words_of(doc_id: int | None, text: str | None, least: int = 1, misspelled: int = 199) -> Counter[str]:
    """The words of a document: runs of Latin-1 letters with A-Z lower-cased. Of about one run in
    ``misspelled`` a code point is left out, chosen by the CRC-32 of the id and the run."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    # outside Latin-1 nothing is a letter here, and lower-casing bytes touches A-Z alone
    for run, n in Counter(_runs(least).findall((text or "").encode("latin-1", "replace").lower())).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), seed)
        if h % misspelled == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            found[word] += n
    return found


def word_counts(documents: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """Words of at least ``least`` code points that occur at least ``often`` times in all documents."""
    ddl = "word STRING, n BIGINT"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=arrow_schema(ddl))
            total.clear()
            return found

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                total.update(words_of(doc_id, text, least))
            if len(total) > HELD:
                yield passed_on()
        yield passed_on()

    return id_and_text(documents).mapInArrow(count, ddl).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# --- comparing blocks ---------------------------------------------------------------


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points, one word a row, padded with zeros."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns every row of ``a`` shares with every row of ``b``."""
    return np.logical_and.accumulate(a[:, None, :] == b[None, :, :], axis=2).sum(axis=2, dtype=np.int32)


class Block:
    """Words of lengths ``m - 1`` and ``m``, from the first and from the last character on."""

    def __init__(self, words: list[str], m: int):
        self.m, self.size = m, len(words)
        self.long = np.fromiter((len(w) == m for w in words), bool, len(words))
        self.front, self.back = matrix(words, m), matrix([w[::-1] for w in words], m)

    def part(self, begin: int, end: int) -> Block:
        block = object.__new__(Block)
        block.m, block.size, block.long = self.m, min(end, self.size) - begin, self.long[begin:end]
        block.front, block.back = self.front[begin:end], self.back[begin:end]
        return block


def single_edits(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are one edit apart, and the lengths of the common prefixes. Two words that are both
    short (length m - 1) are left to the groups of their own length."""
    prefix = common(a.front, b.front)
    apart = prefix + common(a.back, b.back) >= a.m - 1
    return apart & (a.long[:, None] | b.long[None, :]) & (prefix < a.m), prefix


def segment(m: int, j: int, parts: int) -> tuple[int, int]:
    return j * m // parts, (j + 1) * m // parts


class Neighbours:
    """Per word: how many near words, and the most frequent one (the first in order of equal ones)."""

    def __init__(self):
        self.found: dict[str, list] = {}
        self.small: list[tuple[int, list[str], list[int]]] = []
        self.rows, self.m = 0, 0

    def _add(self, word: str, other: str, n: int) -> None:
        held = self.found.get(word)
        if held is None:
            self.found[word] = [1, n, other]
            return
        held[0] += 1
        if n > held[1] or n == held[1] and other < held[2]:
            held[1:] = n, other

    def _pairs(self, mask: np.ndarray, words_a: list[str], n_a: list[int], words_b: list[str], n_b: list[int]) -> None:
        for i, k in zip(*(x.tolist() for x in np.nonzero(mask))):
            self._add(words_a[i], words_b[k], n_b[k])
            self._add(words_b[k], words_a[i], n_a[i])

    def group(self, m: int, j: int, words: list[str], n: list[int], other: tuple[list[str], list[int]] | None, parts: int) -> None:
        """Compare the words of a group with each other, or with those of ``other``, another block of it."""
        if other is None and len(words) <= TOGETHER:
            if m != self.m or self.rows + len(words) > TOGETHER:
                self.flush(parts)
            self.m, self.rows = m, self.rows + len(words)
            self.small.append((j, words, n))
            return
        begin, end = segment(m, j, parts)
        step = max(1, math.isqrt(TILE_CELLS // m))
        a = Block(words, m)
        b, (words_b, n_b) = (a, (words, n)) if other is None else (Block(other[0], m), other)
        for i in range(0, a.size, step):
            for k in range(i if other is None else 0, b.size, step):
                near, prefix = single_edits(a.part(i, i + step), b.part(k, k + step))
                near &= (prefix >= begin) & (prefix < end)
                if other is None and i == k:
                    near = np.triu(near, 1)
                self._pairs(near, words[i : i + step], n[i : i + step], words_b[k : k + step], n_b[k : k + step])

    def flush(self, parts: int) -> None:
        """Compare the small groups that were put together."""
        if self.small:
            words, n = [w for _, own, _ in self.small for w in own], [c for *_, own in self.small for c in own]
            sizes = [len(own) for _, own, _ in self.small]
            number = np.repeat(np.arange(len(sizes)), sizes)
            begin, end = (np.repeat(x, sizes)[:, None] for x in zip(*(segment(self.m, j, parts) for j, *_ in self.small)))
            block = Block(words, self.m)
            near, prefix = single_edits(block, block)
            near &= (number[:, None] == number[None, :]) & (prefix >= begin) & (prefix < end)
            self._pairs(np.triu(near, 1), words, n, words, n)
        self.small, self.rows = [], 0


# --- Spark --------------------------------------------------------------------------

_GROUP = ["m", "j", "shared", "x", "y"]
_NEAR = "word STRING, n_near BIGINT, best_n BIGINT, best STRING"


def _grouped(words: DataFrame, parts: int, block_cells: int) -> DataFrame:
    """Every word in its groups; a group of many words cut into blocks, in one row for every pair of blocks."""
    length = F.length("word")
    keyed = (
        words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
        .withColumn("begin", F.expr(f"j * m div {parts}")).withColumn("rest", F.expr(f"m - (j + 1) * m div {parts}"))
        .select(
            "word", "n", "m", "j",
            F.xxhash64(F.expr("left(word, int(begin))"), F.expr("right(word, int(rest))")).alias("shared")))
    key = ["m", "j", "shared"]
    large = materialise(
        keyed.groupBy(*key).agg(F.count("*").alias("size"))
        .where(F.col("size") * F.col("m") > block_cells)
        .select(*(F.col(c).alias(f"large_{c}") for c in key), F.expr(f"int(ceil(size * m / {block_cells}))").alias("blocks")))
    same = [keyed[c] == large[f"large_{c}"] for c in key]
    return (
        keyed.join(large, same, "left")
        .select(*key, "word", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .withColumn("own", F.expr("int(pmod(xxhash64(word, 7), blocks))"))
        .withColumn("met", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(*key, F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), "own", "word", "n"))


def near_words(words: DataFrame, parts: int = PARTS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """For every word with near words: their number, and the most frequent one with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, schema = Neighbours(), arrow_schema(_NEAR)

        def passed_on() -> pa.RecordBatch:
            rows = [[w, *held] for w, held in found.found.items()]
            found.found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

        def compare(key: tuple, own: list[int], word: list[str], n: list[int]) -> None:
            m, j, _, x, y = key
            if x == y:
                if len(word) > 1:
                    found.group(m, j, word, n, None, parts)
                return
            sides = [([w for w, o in zip(word, own) if o == side], [c for c, o in zip(n, own) if o == side]) for side in (x, y)]
            if sides[0][0] and sides[1][0]:
                found.group(m, j, *sides[0], sides[1], parts)

        key, own, word, n = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in _GROUP])
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            ends = np.append(starts[1:], batch.num_rows)
            # of groups that lie within the batch, single words have no pair
            open_ended = (starts == 0) | (ends == batch.num_rows)
            kept = open_ended | (ends - starts > 1)
            columns = [batch.column(c).to_pylist() for c in ("own", "word", "n")]
            for begin, end in zip(starts[kept].tolist(), ends[kept].tolist()):
                at = tuple(keys[begin].tolist())
                if at != key:
                    if key:
                        compare(key, own, word, n)
                    key, own, word, n = at, [], [], []
                own += columns[0][begin:end]
                word += columns[1][begin:end]
                n += columns[2][begin:end]
            if len(found.found) > HELD:
                yield passed_on()
        if key:
            compare(key, own, word, n)
        found.flush(parts)
        yield passed_on()

    return (
        _grouped(words, parts, block_cells).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        .select(*(F.col(c).cast("long").alias(c) for c in (*_GROUP, "own")), "word", "n")
        .mapInArrow(run, _NEAR)
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("first"))
        .select("word", "n_near", (-F.col("first.col1")).alias("best_n"), F.col("first.best").alias("best")))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """The last word that following ``form`` leads to; each round doubles the steps that are taken."""
    found = materialise(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = materialise(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found


def variants(documents: DataFrame, least: int = 6, often: int = 5, factor: int = 5) -> DataFrame:
    """Every frequent word with its more frequent spelling, if it has one.

    The form of a word is its near word of largest count (the smallest in code-point order of equal
    ones) where that is at least ``factor`` times its own; the root is where following forms ends.
    Null texts have no words, a null id is spelled as nothing before the colon. Repeated rows count
    as often as they come; an empty table gives no rows. Other columns are not read.
    """
    words = materialise(word_counts(documents, least, often))
    near = materialise(near_words(words))
    held = near.withColumnRenamed("word", "near_word")
    judged = materialise(
        words.join(held, words["word"] == held["near_word"], "left")
        .withColumn("changed", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False)))
        .select(
            "word", F.when(F.col("changed"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("changed"), F.col("best_n")).alias("form_n")))
    # counts grow by the factor at every step, which bounds the steps
    most = judged.agg(F.max("form_n")).first()[0] or 1
    forms = _roots(judged.where("form IS NOT NULL"), math.ceil(math.log(most, factor))).withColumnRenamed("word", "changed")
    return (
        judged.join(forms, judged["word"] == forms["changed"], "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
