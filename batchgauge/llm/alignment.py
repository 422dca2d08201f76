"""Alignment of two tokenizations of the same texts, by anchors before space-marked tokens.

A byte-level tokenizer (A) reads a space and the text, a sentencepiece tokenizer (B) the text, which
adds that space itself; both are done in full first. Their tokens spell the same bytes, so token ends
are byte offsets. Where a token of A and a token of B end together and both next tokens begin with a
space (or the text ends) lies an anchor: the shared end is verified, not assumed. Anchors part a
document into windows, mostly words, and a window's alignment depends on its ids alone: it is worked
out once and remembered by its two id tuples.

A link holds the two tokens that end together. One of the two then spells an end of the other, so
there are at most as many linked pairs of ids as ends of tokens that are tokens of the other
vocabulary: some hundred thousand, whatever the corpus. That bounds the table of corpus-wide counts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, per_slice
from batchgauge.llm.units import Memo, byte_letters, byte_level_units, packed, stops_end_words, text_ids
from batchgauge.session import materialise

SPACE = "▁"
"""What sentencepiece writes for a space."""
_COMMA, _BAR, _SEMICOLON, _LINE = range(4)
_OF_B = np.uint32(1 << 31)
"""Marks the ids of B in the key of a window."""
CHANGED = b"\xff" * 4
"""Stands for the ids of a word whose pieces spell something else; no id has these bytes."""
_WORDS = re.compile(r" +[^ ]*")
_STOPPED = re.compile(r"[^\W_][.,]")


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = {letter: i for i, letter in enumerate(byte_letters())}
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        found[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return found


class Pieces:
    """A sentencepiece model: the bytes of its ids, and encoding with words remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)]
        # Where no piece goes on with a space, a space behind another character always begins a piece.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        # Letters and digits that a piece joins to a full stop or comma; behind others one always begins a piece.
        self.glued = {pair for p in pieces for pair in _STOPPED.findall(p)}
        self.lead = "a"  # encoded before a unit without the space that the model adds, and dropped again
        self.lead_ids = model.encode(self.lead)
        self.by_stops = self.by_words and not {self.lead + ".", self.lead + ","} & self.glued
        self.memo = Memo(self._encode)

    def _encode(self, units: list[str]) -> list[bytes]:
        """Units begin with the space that the model adds, or with a full stop or comma; a space alone the model
        would take for no text."""
        found = self.model.encode([u[1:] if u[0] == " " else self.lead + u for u in units], num_threads=1)
        look = self.bytes_of.__getitem__
        for at, unit in enumerate(units):
            if unit == " ":
                found[at] = [self.model.piece_to_id(SPACE)]
            elif unit[0] != " ":
                found[at] = found[at][len(self.lead_ids) :]
        return [
            packed(ids) if b"".join(map(look, ids)) == unit.encode("utf-8", "replace") else CHANGED for unit, ids in zip(units, found)]

    def ids(self, spaced: list[str]) -> list[bytes]:
        """The ids of texts that are given with the space in front; none where the pieces spell another text."""
        found = self.memo.ids([self._words(t) for t in spaced])
        return [b"" if CHANGED in ids else ids for ids in found]

    def _words(self, spaced: str) -> list[str]:
        """Units that begin with a space, or the run of spaces before a word; or with the full stop or comma behind one."""
        if not self.by_words:
            return [spaced]
        if "  " in spaced or "\0" in spaced:
            return _WORDS.findall(spaced)
        if self.by_stops and stops_end_words(spaced) and not any(pair in spaced for pair in self.glued):
            spaced = spaced.replace(".", "\0.").replace(",", "\0,")
        return spaced.replace(" ", "\0 ").split("\0")[1:]


def _pairs(tokens_a: list[bytes], tokens_b: list[bytes]) -> np.ndarray:
    """All pairs of ids (A << 32 | B) of which one spells an end of the other, in order."""
    by_bytes: dict[bytes, tuple[list[int], list[int]]] = {}
    for side, tokens in enumerate((tokens_a, tokens_b)):
        for i, token in enumerate(tokens):
            if token:
                by_bytes.setdefault(token, ([], []))[side].append(i)
    found = set()
    for token, (own_a, own_b) in by_bytes.items():
        for at in range(len(token)):
            if end := by_bytes.get(token[at:]):
                found.update(a << 32 | b for a in own_a for b in end[1])
                found.update(a << 32 | b for a in end[0] for b in own_b)
    return np.array(sorted(found), np.int64)


class Aligner:
    """``a``: a byte-level tokenizers file with split ``pattern``; ``b``: a sentencepiece model."""

    def __init__(self, a: str, b: str, pattern: str, limit: int = 128 << 20):
        self.path, self.pattern, self.limit = a, pattern, limit
        self.pieces = Pieces(b)
        self.bytes_a, self.bytes_b = byte_level_tokens(a), self.pieces.bytes_of
        self.length_a, self.length_b = (np.array([len(t) for t in side]) for side in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in side]) for side in (self.bytes_a, self.bytes_b))
        if not {bytes([i]) for i in range(256)} <= set(self.bytes_a):
            raise ValueError("a byte-level vocabulary has a token for every byte")  # so its tokens spell any text
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.decimal = [b"%d%s" % (i, after) for i in range(most) for after in (b",", b"|", b";", b"\n")]
        self.pairs = _pairs(self.bytes_a, self.bytes_b)
        self.windows: dict[bytes, tuple[bytes, bytes]] = {}  # the newer half of what is remembered
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        return self.tokenised([text])[0]

    def tokenised(self, found: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids of A and of B; none for texts that are null, empty, or spelled otherwise by either."""
        out = [(b"", b"")] * len(found)
        live = [i for i, t in enumerate(found) if t]
        spaced = [" " + found[i] for i in live]
        ids_a = text_ids(self.path, spaced, lambda t: byte_level_units(t, self.pattern), self.pattern)
        for i, a, b in zip(live, ids_a, self.pieces.ids(spaced)):
            if b:
                out[i] = a, b
        return out

    def _shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens of both sides end together: the places of the two tokens. Both spell the same bytes."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        near = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[near] == end_a)
        return last_a, near[last_a]

    def _aligned(self, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The groups of windows as text, and their links as numbers of ``pairs``, for many windows at once."""
        ids = np.frombuffer(b"".join(keys), "<u4")
        of_b = ids >= _OF_B
        a, b = ids[~of_b].astype(np.int64), (ids[of_b] - _OF_B).astype(np.int64)
        stops = np.cumsum([len(key) // 4 for key in keys])
        stop_a = np.cumsum(~of_b)[stops - 1]
        last_a, last_b = self._shared(a, b)
        # tokens in the order of the text: a group's tokens of A, then those of B, each with what follows it
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        written = np.empty(len(ids), np.int64)
        after_a, after_b = np.full(len(a), _COMMA), np.full(len(b), _COMMA)
        after_a[last_a], after_b[last_b] = _BAR, _SEMICOLON
        after_b[last_b[np.searchsorted(last_a, stop_a - 1)]] = _LINE
        written[np.arange(len(a)) + np.repeat(last_b - size_b + 1, size_a)] = a * 4 + after_a
        written[np.arange(len(b)) + np.repeat(last_a + 1, size_b)] = b * 4 + after_b
        groups = b"".join(map(self.decimal.__getitem__, written.tolist())).split(b"\n")
        numbers = np.searchsorted(self.pairs, a[last_a] << 32 | b[last_b]).astype("<u4").tobytes()
        ends = (np.searchsorted(last_a, stop_a) * 4).tolist()
        return list(zip(groups, [numbers[i:j] for i, j in zip([0, *ends], ends)]))

    def _keep(self, windows: dict[bytes, tuple[bytes, bytes]]) -> None:
        # a text without spaces is one long window that does not come again
        short = {key: window for key, window in windows.items() if len(key) < 1024}
        self.windows.update(short)
        self.held += sum(len(key) + len(g) + len(n) for key, (g, n) in short.items()) + 350 * len(short)

    def _windows(self, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The alignments of windows, remembered in two halves, of which the older one is dropped when the newer is full."""
        if self.held > self.limit // 2:
            self.windows, self.older, self.held = {}, self.windows, 0
        found = list(map(self.windows.get, keys))
        gaps = [at for at, window in enumerate(found) if window is None]
        if gaps:
            new, older = {keys[at] for at in gaps}, self.older
            made = {key: older[key] for key in new if key in older}
            new = [key for key in new if key not in made]
            if new:
                made.update(zip(new, self._aligned(new)))
            self._keep(made)
            for at in gaps:
                found[at] = made[keys[at]]
        return found

    def align(self, tokens: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """Groups and links of texts given by their ids; empty where a text has no tokens."""
        out = [(b"", b"")] * len(tokens)
        live = [i for i, (a, _) in enumerate(tokens) if a]
        if not live:
            return out
        a, b = (np.frombuffer(b"".join([tokens[i][side] for i in live]), "<u4") for side in (0, 1))
        last_a, last_b = self._shared(a, b)  # verified ends
        anchor = np.append(self.spaced_a[a], True)[last_a + 1] & np.append(self.spaced_b[b], True)[last_b + 1]
        stop_a, stop_b = last_a[anchor] + 1, last_b[anchor] + 1
        # a text begins with a space, so every text ends with an anchor
        ends = np.searchsorted(stop_a, np.cumsum([len(tokens[i][0]) // 4 for i in live]), side="right").tolist()
        # the two id tuples of a window one behind the other, those of B marked
        tuples = np.empty(len(a) + len(b), "<u4")
        tuples[np.arange(len(a)) + np.repeat(np.append(0, stop_b[:-1]), np.diff(stop_a, prepend=0))] = a
        tuples[np.arange(len(b)) + np.repeat(stop_a, np.diff(stop_b, prepend=0))] = b | _OF_B
        ids, stops = tuples.tobytes(), ((stop_a + stop_b) * 4).tolist()
        keys = [ids[i:j] for i, j in zip([0, *stops], stops)]
        windows = self._windows(keys)
        groups, links = [g for g, _ in windows], [n for _, n in windows]
        start = 0
        for i, end in zip(live, ends):
            out[i] = b";".join(groups[start:end]), b"".join(links[start:end])
            start = end
        return out


# --- Spark --------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def loaded(a: str, b: str, pattern: str) -> Aligner:
    """The aligner of a Python worker; built once, then kept with what it remembers."""
    return Aligner(a, b, pattern)


def groups(documents: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    """``doc_id`` and the groups of every text, as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        aligner = loaded(a, b, pattern)
        found = aligner.align(aligner.tokenised(batch.column("text").to_pylist()))
        return [batch.column("doc_id").to_pylist(), [g.decode() for g, _ in found]]

    return per_slice(id_and_text(documents), "doc_id BIGINT, groups STRING", rows)


def linked(documents: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    """Counts, the digest of the groups and the links (numbers of ``Aligner.pairs``) of every text."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        aligner = loaded(a, b, pattern)
        tokens = aligner.tokenised(batch.column("text").to_pylist())
        found = aligner.align(tokens)
        return [
            batch.column("doc_id").to_pylist(), [len(x) // 4 for x, _ in tokens], [len(y) // 4 for _, y in tokens],
            [len(n) // 4 for _, n in found], [hashlib.sha256(g).hexdigest() if g else "" for g, _ in found], [n for _, n in found],
        ]

    return per_slice(
        id_and_text(documents),
        "doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, groups_sha256 STRING, links BINARY", rows)


def pair_counts(links: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    """How many links of the whole corpus hold each pair of ids. A task counts its own first."""
    ddl = "a_id BIGINT, b_id BIGINT, n BIGINT"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(a, b, pattern).pairs
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                found = b"".join(batch.column("links").slice(at, 4096).to_pylist())
                total += np.bincount(np.frombuffer(found, "<u4"), minlength=len(pairs))
        held = np.flatnonzero(total)
        columns = [pa.array(c) for c in (pairs[held] >> 32, pairs[held] & 0xFFFFFFFF, total[held])]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(ddl))

    return links.select("links").mapInArrow(count, ddl).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def align(documents: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    """Align every whole text and hold its links against the counts of the corpus.

    Texts that are null, empty or spelled otherwise by a tokenizer have zeros and an empty digest.
    Rows come out as they came in, repeated ones and rows without id too, and each counts in the
    corpus; an empty table gives no rows. Other columns are not read. The counts go through the
    driver: one row per pair of ids that can be linked at all, which the vocabularies bound.
    """
    spark = documents.sparkSession
    stored = materialise(linked(documents, a, b, pattern))
    pairs = loaded(a, b, pattern).pairs
    counted = pair_counts(stored, a, b, pattern).toArrow()
    ids_a, ids_b, n = (counted.column(c).to_numpy() for c in ("a_id", "b_id", "n"))
    count, highest = np.zeros(len(pairs), np.int64), np.zeros(int(ids_b.max(initial=0)) + 1, np.int64)
    count[np.searchsorted(pairs, ids_a << 32 | ids_b)] = n
    np.maximum.at(highest, ids_b, n)
    best = np.zeros(len(pairs), np.int64)
    best[np.searchsorted(pairs, ids_a << 32 | ids_b)] = n == highest[ids_b]
    shared = spark.sparkContext.broadcast((count, best))

    def rows(batch: pa.RecordBatch) -> list[list]:
        count, best = shared.value
        found = batch.column("links").to_pylist()
        sizes = np.array([len(x) // 4 for x in found])
        numbers, ends = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes)
        sums = [np.append(0, np.cumsum(table[numbers])) for table in (best, count)]
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups")]
        return [*columns, sizes.tolist(), *((s[ends] - s[ends - sizes]).tolist() for s in sums), batch.column("groups_sha256").to_pylist()]

    return per_slice(
        stored,
        "doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_best BIGINT, count_sum BIGINT, groups_sha256 STRING",
        rows)
