"""Byte-level BPE as a finite-state transducer, determinised on demand.

A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and
every two neighbours stay apart when encoded together. So merges compile into a nondeterministic
transducer: it walks a trie of the vocabulary and may end a token wherever the token before it and
this one stay apart. Reading a byte turns a set of hypotheses (trie nodes, one for every suffix of
what was read that begins a token) into another, and the deepest of them says which the others are:
the subset construction has as many states as the trie, and its transitions are built as they are
met and kept. Of the tokens that end with a byte exactly one stays apart from the token that was
written where it begins: a transition therefore writes one token per byte, the one that ends there
if the text does, and looks back at those written before. The borders that all open hypotheses have
passed are final. Hypotheses reach back one token length at most, which bounds the lookahead.

Decoding joins the bytes of ids and cuts complete characters off with a UTF-8 state machine that
carries an unfinished character over to the next chunk.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from batchgauge.llm.batches import id_and_text, long_slices, per_slice, texts
from batchgauge.llm.units import Memo, packed

MOVES = 600_000
"""Transitions kept at a time; beyond it the table is built anew."""
PAIRS = 600_000
"""Pairs of tokens whose answer is remembered."""
MEMO_BYTES = 256 << 20
"""Units that a worker remembers: words keep their case here."""
NEVER = 1 << 60


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.parent = [-1], [(0, 0)]
        for token, rank in ranks.items():
            if self.merged(token) != [rank]:
                continue  # never the outcome of merges; only a whole match may stand for it
            node = 0
            for byte in token:
                key = node << 8 | byte
                parent, node = node, self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.parent.append((parent, byte))
            self.token[node] = rank
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        self.longest = max(map(len, ranks), default=1)
        self.suffixes: dict[int, tuple] = {0: ((0, 0),)}
        self.states: dict[int, tuple] = {}
        self.moves: dict[int, tuple] = {}
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.edges: dict[int, tuple[list, list]] = {}

    def merged(self, data: bytes, seen=lambda parts, rank: None) -> list[int]:
        """The merges applied by rank, lowest first: the definition, used on single tokens.

        ``seen`` is told the parts before each merge, and its rank.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank == NEVER:
                break
            seen(parts, rank)
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge_parts(self, token: int) -> tuple[list, list]:
        """The parts that stand at a token's left and right end while it is merged.

        Each comes with the rank of the merge that ends it.
        """
        found = self.edges.get(token)
        if found is None:
            first: dict[bytes, int] = {}
            last: dict[bytes, int] = {}

            def seen(parts, rank):
                first[parts[0]] = last[parts[-1]] = rank

            self.merged(data := self.bytes_of[token], seen)
            first[data] = last[data] = NEVER
            found = self.edges[token] = list(first.items()), list(last.items())
        return found

    def _apart_from(self, right: int) -> dict[int, bool]:
        """The answers known for a token, by the token before it (-1: none)."""
        return self.apart.setdefault(right, {-1: True})

    def stay_apart(self, left: int, right: int) -> bool:
        known = self._apart_from(right).get(left)
        if known is None:
            if self.pairs >= PAIRS:
                for answers in self.apart.values():  # emptied in place: states refer to them
                    answers.clear()
                    answers[-1] = True
                self.pairs = 0
            self.pairs += 1
            # Merges run in order of rank. One across the border comes about if it has its turn while
            # both parts beside the border stand; of equal ranks the one further left is first.
            known = self.apart[right][left] = not any(
                (rank := self.ranks.get(a + b, NEVER)) < end_a and rank <= end_b and rank < NEVER
                for a, end_a in self._edge_parts(left)[1]
                for b, end_b in self._edge_parts(right)[0]
            )
        return known

    def _open(self, node: int) -> tuple:
        """The (depth, node) of every suffix of a node's bytes that begins a token, longest first."""
        found = self.suffixes.get(node)
        if found is None:
            parent, byte = self.parent[node]
            ahead = [(d + 1, self.child.get(n << 8 | byte)) for d, n in self._open(parent)]
            found = self.suffixes[node] = (*((d, n) for d, n in ahead if n is not None), (0, 0))
        return found

    def _state(self, node: int) -> tuple:
        """A state: its trie node, shifted for the next byte, and the tokens that end in it.

        All but the shortest token come as (place of the token before it from the end, token, answers
        known for it), longest first. The shortest is the one that ends if none of these does.
        """
        found = self.states.get(node)
        if found is None:
            ends = [(-depth, self.token[n]) for depth, n in self._open(node) if self.token[n] >= 0]
            others = [(place, token, self._apart_from(token)) for place, token in ends[:-1]]
            found = self.states[node] = node << 8, others, ends[-1][1]
        return found

    def _move(self, key: int) -> tuple:
        """Build a transition from a state's shifted node and a byte."""
        if len(self.moves) >= MOVES:
            self.moves.clear()
        ahead = (self.child.get(n << 8 | key & 255) for _, n in self._open(key >> 8))
        found = self.moves[key] = self._state(next(n for n in ahead if n is not None))
        return found

    def _settled(self, node: int, ended: list[int]) -> int:
        """The last border that every open hypothesis has passed; what stands before it is final."""
        at, common = len(ended) - 1, None
        for depth, _ in self._open(node):
            border, borders = at - depth, set()
            while border > 0:
                borders.add(border)
                border -= self.sizes[ended[border]]
            common = borders if common is None else common & borders
        return max(common, default=0)

    def _read_back(self, ended: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes; ``ended[i]`` is the token that ends before byte i."""
        out, size = [], self.sizes
        while at > 0:
            token = ended[at]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def encode(self, match: bytes) -> list[int]:
        """The ids of one match of the split pattern."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        move, most = self.moves.get, 8 * self.longest
        node, out, ended = 0, [], [-1]
        for start in range(0, len(match), most):
            for byte in match[start : start + most]:
                key = node | byte
                node, others, token = move(key) or self._move(key)
                for place, longer, answers in others:
                    last = ended[place]
                    apart = answers.get(last)
                    if apart is None:
                        apart = self.stay_apart(last, longer)
                    if apart:
                        token = longer
                        break
                ended.append(token)
            if start + most < len(match):
                at = self._settled(node >> 8, ended)
                out += self._read_back(ended, at)
                ended = ended[at:]
        return out + self._read_back(ended, len(ended) - 1)


# --- decoding -----------------------------------------------------------------------

LEADS = ((0x00, 0x7F, 1), (0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4))
"""Fixed values: first bytes of UTF-8 characters and the characters' lengths."""


class Utf8Stream:
    """Decodes bytes as they come. The state is the unfinished character at the end of a chunk."""

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self._unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character without completing it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if not 0x80 <= byte <= 0xBF:
                needed = next((n for low, high, n in LEADS if low <= byte <= high), 1)
                return back if needed > back else 0
        return 0


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            self.bytes_of[rank] = data

    def chunks(self, ids: list[int], at_once: int = 65536):
        """The bytes of ids, chunk by chunk."""
        for i in range(0, len(ids), at_once):
            yield b"".join(map(self.bytes_of.__getitem__, ids[i : i + at_once]))

    def text(self, ids: list[int], at_once: int = 65536) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(c) for c in self.chunks(ids, at_once)), stream.finish()])


# --- Spark --------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def _loaded(path: str, pattern: str):
    """Coder, memo and tables of a Python worker; built once, then kept."""
    gc.set_threshold(200_000, 50, 50)  # as for a library's memo: full collections visit all that is remembered
    ranks = read_ranks(path)
    machine, decoder = Transducer(ranks), Decoder(ranks)

    def encode(found: list[str]) -> list[bytes]:
        return [packed(machine.encode(m.encode("utf-8", "replace"))) for m in found]

    return Memo(encode, MEMO_BYTES, pattern), decoder, list(map(str, range(len(decoder.bytes_of))))


def encode_decode(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids again, and return digests of both.

    ``decoded_ok`` says that the decoded characters are the text. Null counts as empty; rows come
    out as they came in, repeated ones too.
    """

    def rows(batch: pa.RecordBatch) -> list[list]:
        memo, decoder, decimal = _loaded(ranks, pattern)
        found = texts(batch)
        out: list[list] = [batch.column("doc_id").to_pylist(), [], [], [], []]
        for text, packed in zip(found, memo.byte_level_ids(found, pattern)):
            ids = np.frombuffer(packed, "<u4").tolist()
            digest, stream, same, at = hashlib.sha256(), Utf8Stream(), True, 0
            for chunk in decoder.chunks(ids):
                digest.update(chunk)
                piece = stream.feed(chunk)
                same = same and text.startswith(piece, at)
                at += len(piece)
            rest = stream.finish()
            out[1].append(len(ids))
            out[2].append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            out[3].append(digest.hexdigest())
            out[4].append(same and text[at:] == rest)
        return out

    return per_slice(id_and_text(documents), "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING, decoded_ok BOOLEAN", rows,
                     long_slices)
