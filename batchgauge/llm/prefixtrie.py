"""BPE by a trie of distinct words, each prefix encoded once.

Every prefix of a word has an encoding of its own, and all but its last token is the encoding of a
shorter prefix: the last token is the one token that ends the prefix and stays apart from the last
token of what precedes it. So the distinct words of a task go into a trie, a depth-first walk gives
every node its last token from those on the path above it, and a shared prefix is worked out once,
whatever number of words go on from it. The ids of a word are read off its last node backwards.

The letter that closes a word is a symbol of its own, as merges with a word-end suffix want it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from batchgauge.llm.batches import id_and_text, per_slice, texts
from batchgauge.llm.units import Memo, blank_separated_units, byte_letters, packed

CLOSING = 0x1000
"""Added to a letter's code point where the letter closes its word."""
NODES = 400_000
"""Nodes of the trie kept at a time; beyond it the trie is begun anew."""
PAIRS = 600_000
"""Pairs of tokens whose answer is remembered."""


class PrefixTrie:
    """``vocabulary``: id by token; ``merges``: pairs of tokens, the earlier the sooner; ``suffix`` marks closing tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        def symbols(token: str) -> str:
            body = token.removesuffix(suffix) if suffix else token
            return token if len(body) == len(token) or not body else body[:-1] + chr(ord(body[-1]) + CLOSING)

        self.suffix = suffix
        self.symbols = {i: symbols(t) for t, i in vocabulary.items()}
        self.letter = {s: i for i, s in self.symbols.items() if len(s) == 1}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.rank[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        # a token that its own merges do not lead to is never written
        self.tokens = {s: i for i, s in self.symbols.items() if all(c in self.letter for c in s) and self.merged(s) == [i]}
        self.prefixes = {s[:n] for s in self.tokens for n in range(1, len(s) + 1)}
        # an automaton over the tokens: a state is the longest end of the path that a token begins with
        self.number, self.spelled, self.step = {"": 0}, [""], {}
        self.endings: list[list[tuple[int, int]]] = [[]]
        self.apart: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.begin, self.state = [-1], [0], [0]

    def closed(self, word: str) -> str:
        """The symbols of a word: its letters, the last one closing where the vocabulary has closing tokens."""
        return word[:-1] + chr(ord(word[-1]) + CLOSING) if self.suffix and word else word

    def merged(self, symbols: str) -> list[int]:
        """The ids that merging pair by pair gives: the earliest merge first, the leftmost of equal ones."""
        ids, rank = [self.letter[c] for c in symbols], self.rank.get
        while True:
            best = min(((found[0], i, found[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (found := rank(pair))), default=None)
            if best is None:
                return ids
            ids[best[1] : best[1] + 2] = [best[2]]

    def stay_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[key] = self.merged(self.symbols[left] + self.symbols[right]) == [left, right]
        return known

    def _advance(self, state: int, symbol: str) -> int:
        """The state after ``symbol``, numbered with the tokens that end there, the longest first."""
        end = self.spelled[state] + symbol
        while end not in self.prefixes:
            end = end[1:]
        found = self.number.get(end)
        if found is None:
            found = self.number[end] = len(self.spelled)
            self.spelled.append(end)
            self.endings.append([(self.tokens[e], len(e)) for i in range(len(end)) if (e := end[i:]) in self.tokens])
        self.step[state << 13 | ord(symbol)] = found
        return found

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words, visited in the order of a depth-first walk."""
        if len(self.last) > NODES:
            self.clear()
        child, step, endings, apart = self.child, self.step, self.endings, self.apart
        last, begin, states = self.last, self.begin, self.state
        found: dict[str, list[int]] = {}
        path, before = [0], ""
        for symbols, word in sorted([(self.closed(w), w) for w in words]):
            shared = 0
            for a, b in zip(before, symbols):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for symbol in symbols[shared:]:
                at = ord(symbol)
                key = path[-1] << 13 | at
                node = child.get(key)
                if node is None:  # a prefix not met before: its last token follows from those above
                    state = states[path[-1]]
                    state = step.get(state << 13 | at) or self._advance(state, symbol)
                    for token, length in endings[state]:
                        start = path[-length]
                        if not start:
                            break
                        fits = apart.get(last[start] << 32 | token)
                        if self.stay_apart(last[start], token) if fits is None else fits:
                            break
                    else:
                        raise ValueError(f"no token ends {self.spelled[state]!r}")
                    node = child[key] = len(last)
                    last.append(token)
                    begin.append(start)
                    states.append(state)
                path.append(node)
            ids = []
            while node:
                ids.append(last[node])
                node = begin[node]
            ids.reverse()
            found[word] = ids
            before = symbols
        return found


# --- words of a text ----------------------------------------------------------------

# The matches of the tokenizer's own pattern in lower-case ASCII without blanks.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Coder:
    """Encoding and decoding by a tokenizers file whose model is BPE over bytes between white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = PrefixTrie(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        added = library.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must be plain strings")
        self.added = {t.content: i for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_in = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.known: dict[str, list[int]] = {}
        self.memo = Memo(self._encode)

    def _pieces(self, unit: str) -> list[str]:
        """The words of a unit without blanks, in the letters that stand for bytes."""
        if unit.isascii() and unit.isprintable():
            return _ASCII_PIECES.findall(unit.lower())
        if unit.isalpha() and max(unit) <= "\xff":  # Latin-1 is in normal form, and its letters are one word
            return [unit.lower().encode().decode("latin-1").translate(self.letters)]
        return [piece for piece, _ in self.cut(self.normalize(unit))]

    def _encode(self, units: list[str]) -> list[bytes]:
        pieces = [self._pieces(u) for u in units]
        if len(self.known) > 200_000:
            self.known.clear()
        self.known |= self.trie.encode(set().union(*pieces).difference(self.known))
        known = self.known
        return [packed(known[p[0]] if len(p) == 1 else [i for piece in p for i in known[piece]]) for p in pieces]

    def encode(self, found: list[str]) -> list[bytes]:
        """The ids of texts as little-endian 32-bit integers; strings of added tokens become their ids."""
        holds = self.added_in.search if self.added_in else lambda text: None
        parts = [self.added_in.split(t) if holds(t) else [t] for t in found]
        between = iter(self.memo.ids([blank_separated_units(p) for parted in parts for p in parted[::2]]))
        out = []
        for parted in parts:  # a text, an added token, a text, ...
            ids = [next(between)]
            for name in parted[1::2]:
                ids += packed([self.added[name]]), next(between)
            out.append(b"".join(ids))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file has no decoder of its own."""
        return " ".join(map(self.name.__getitem__, ids))


# --- Spark --------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Coder:
    """The coder of a Python worker; built once, then kept with its trie."""
    return Coder(path)


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode its ids again, and return digests of both.

    Null counts as empty: no ids, an empty decoded text. Rows come out as they came in, repeated
    ones and rows without id too; an empty table gives no rows. Other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> list[list]:
        coder = loaded(path)
        out: list[list] = [batch.column("doc_id").to_pylist(), [], [], []]
        for ids in coder.encode(texts(batch)):
            out[1].append(len(ids) // 4)
            out[2].append(hashlib.sha256(ids).hexdigest())
            out[3].append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return out

    return per_slice(id_and_text(documents), "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING", rows)


def token_ids(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ids of every whole text; null counts as empty."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        found = loaded(path).encode(texts(batch))
        return [batch.column("doc_id").to_pylist(), [np.frombuffer(ids, "<u4").tolist() for ids in found]]

    return per_slice(id_and_text(documents), "doc_id BIGINT, ids ARRAY<BIGINT>", rows)
