"""Cutting texts where a tokenizer cuts them anyway, and remembering the ids of frequent units.

Invented and natural prose repeats most of its words, so the tokenizers library is asked once for
each distinct unit a task sees, not once for each occurrence. Cuts are made only where both sides
are encoded independently, so joined ids equal those of the whole text.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import string
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_TWO_BLANKS = re.compile(r"\s\s")
_BLANKS_OF_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
_STOP_BEHIND_NO_WORD = re.compile(r"[.,](?<=[\W_].)")


@functools.lru_cache(maxsize=4)
def _matcher(pattern: str):
    # White_Space is what \s means to the tokenizer libraries; Python's also has \x1c-\x1f.
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def matches(text: str, pattern: str) -> list[str]:
    """The matches of a byte-level tokenizer's split pattern, which cover the whole text."""
    return _matcher(pattern).findall(text)


def stops_end_words(text: str) -> bool:
    """Whether every full stop and comma stands behind a letter or digit, so that it begins a match.

    All of Python's alphanumeric characters are letters or numbers to the tokenizer libraries.
    """
    return not _STOP_BEHIND_NO_WORD.search(text)


def byte_level_units(text: str, pattern: str) -> list[str]:
    """Units for a byte-level tokenizer whose matches begin with one space at most.

    While no two blanks meet, every space begins a match and every line feed is one. Other texts
    are cut by the pattern itself, which is slower. Full stops and commas behind words begin units,
    so that a word is the same unit with and without them.
    """
    marked = _marked(text)
    return matches(text, pattern) if marked is None else marked.split("\0")


def _marked(text: str) -> str | None:
    """The text with a zero between its byte-level units; none for texts that the pattern has to cut."""
    if "\0" in text or _TWO_BLANKS.search(text):
        return None
    if stops_end_words(text):
        text = text.replace(".", "\0.").replace(",", "\0,")
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def blank_separated_units(text: str) -> list[str]:
    """Units for a tokenizer that drops white space."""
    return [text] if _BLANKS_OF_PYTHON_ONLY.search(text) else text.split()


def small_units(text: str) -> list[str]:
    """Units for a tokenizer that drops white space, composes, lower-cases and parts letters, digits and the rest.

    Texts of Latin-1 characters are composed, and lower-cased as a whole. Full stops and commas behind their
    words begin units, so that a word is the same unit with and without them. In other texts a letter may
    become a letter and a mark, which goes with what follows.
    """
    if not _latin(text) or _BLANKS_OF_PYTHON_ONLY.search(text):
        return blank_separated_units(text)
    text = text.lower()
    if stops_end_words(text):
        text = text.replace(".", " .").replace(",", " ,")
    return text.split()


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _plain_word(unit: str) -> list[str] | None:
    """The matches of a word, with a space before or ASCII punctuation behind, without the pattern."""
    word = unit[1:] if unit[:1] == " " else unit
    if word.isalpha():
        return [unit]
    body = word.rstrip(string.punctuation)  # one match: no letter behind it could make a contraction of it
    if body.isalpha():
        at = len(body) - len(word)
        return [unit[:at], unit[at:]]
    return None


def _small_word(word: str) -> list[str]:
    """A word of Latin-1 letters as its lower-case letters and the punctuation behind; other words as they are.

    For a tokenizer that composes, lower-cases and parts letters from punctuation: the parts have the ids of the word.
    """
    cut = _plain_word(word)
    if cut and _latin(word):
        cut[0] = cut[0].lower()
        return cut
    return [word]


MEMO_BYTES = 128 << 20
"""What a memo holds at most, unless its user has more memory for it."""


class Memo:
    """Ids of units as little-endian 32-bit integers, up to ``limit`` bytes.

    Units are kept in two halves. Once the newer is full it becomes the older, and what is not asked
    for again while the next one fills is forgotten; frequent units stay.
    With ``pattern``, a unit not seen before is cut into its matches, or into what ``cut`` makes of it,
    and only new parts are encoded.
    """

    def __init__(
        self, encode: Callable[[list[str]], list[bytes]], limit: int = MEMO_BYTES, pattern: str | None = None,
        cut: Callable[[str], list[str]] | None = None,
    ):
        self.encode, self.limit, self.size, self.pattern = encode, limit, 0, pattern
        self.cut = cut or (pattern and (lambda unit: _plain_word(unit) or matches(unit, pattern)))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _keep(self, units: list[str], found: list[bytes]) -> None:
        self.known.update(zip(units, found))
        self.size += sum(map(len, units)) + sum(map(len, found)) + 180 * len(units)

    def _unknown(self, units: Iterable[str]) -> list[str]:
        """The units that are in neither half; those in the older one are taken over."""
        older, known = self.older, self.known
        if not older:
            return [u for u in units if u not in known]
        units = [u for u in units if u not in known]
        again = [u for u in units if u in older]
        self._keep(again, [older[u] for u in again])
        return [u for u in units if u not in older]

    def _turn(self) -> None:
        if self.size > self.limit // 2:
            self.known, self.older, self.size = {}, self.known, 0

    def ids(self, lists: list[list[str]]) -> list[bytes]:
        """The joined ids of every list of units; known units are looked up once."""
        self._turn()
        look = self.known.get
        found = [list(map(look, units)) for units in lists]
        gaps = [[at for at, ids in enumerate(one) if ids is None] for one in found]
        new = self._unknown({units[at] for units, gap in zip(lists, gaps) for at in gap})
        if new:
            self._learn(new)
        for units, one, gap in zip(lists, found, gaps):
            for at in gap:
                one[at] = look(units[at])
        return list(map(b"".join, found))

    def _ids_of_distinct(self, units: list[str]) -> list[bytes]:
        self._turn()
        found = list(map(self.known.get, units))
        new = [u for u, ids in zip(units, found) if ids is None]
        if not new:
            return found
        if self.older:
            new = self._unknown(new)
        self._learn(new)
        look = self.known.__getitem__
        return [look(u) if ids is None else ids for u, ids in zip(units, found)]

    def byte_level_ids(self, texts: list[str], pattern: str) -> list[bytes]:
        """The ids of texts by their byte-level units; Arrow finds the distinct ones of all texts, and only those are looked up."""
        marked = list(map(_marked, texts))
        by_pattern = {i: matches(t, pattern) for i, (t, m) in enumerate(zip(texts, marked)) if m is None}
        whole = dict(zip(by_pattern, self.ids(list(by_pattern.values()))))
        units = pc.split_pattern(pa.array([m or "" for m in marked], pa.large_string()), "\0")
        named = units.flatten().dictionary_encode()
        found = self._ids_of_distinct(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, bounds, data = pa.array(found, pa.large_binary()).take(named.indices).buffers()
        ends, data = np.frombuffer(bounds, np.int64)[units.offsets.to_numpy()].tolist(), memoryview(data or b"")
        return [whole[i] if i in whole else bytes(data[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))]

    def _learn(self, new: list[str]) -> None:
        if not self.cut:
            self._keep(new, self.encode(new))
            return
        if self.pattern:  # most units are one match
            words, rest = [], []
            for u in new:
                (words if u.isalpha() or u[:1] == " " and u[1:].isalpha() else rest).append(u)
            self._keep(words, self.encode(words))
            new = rest
        cut = list(map(self.cut, new))
        parts = self._unknown(set().union(*cut))
        self._keep(parts, self.encode(parts))
        joined = [(u, c) for u, c in zip(new, cut) if len(c) != 1 or c[0] != u]
        look = self.known.__getitem__
        self._keep([u for u, _ in joined], [b"".join(map(look, c)) for _, c in joined])


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return _PACKERS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> str:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 itself,
    then the letters from U+0100 on for the other bytes in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The file's tokenizer, for which strings of added tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def forget() -> None:
    """Drop what the worker remembers; for tasks that tokenize nothing."""
    library_memo.cache_clear()
    _added.cache_clear()
    _tokenizer.cache_clear()


@functools.lru_cache(maxsize=4)
def library_memo(path: str, pattern: str | None = None, limit: int = MEMO_BYTES) -> Memo:
    """A memo in front of a tokenizers file; lives as long as the Python worker.

    With ``pattern`` the file is a byte-level one and units are its matches. Else units are words
    between blanks, which the file's own normalizer and pre-tokenizer cut further.
    """
    # A slice of rows makes some hundred thousand short lists and no cycles; each full collection visits all that is
    # remembered, and with the default thresholds there are several of them a slice.
    gc.set_threshold(200_000, 50, 50)
    tokenizer = _tokenizer(path)
    model, letters = tokenizer.model, byte_letters()

    def ids_of(piece: str) -> list[int]:
        return [t.id for t in model.tokenize(piece)]

    def named(piece: str) -> str:
        """A piece in the letters of the vocabulary; printable ASCII but the space stands for itself."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", letters[0x20])
        return piece.encode("utf-8", "replace").decode("latin-1").translate(letters)

    codes = np.frombuffer(letters.encode("utf-16-le"), "<u2")

    def all_named(found: list[str]) -> list[str]:
        """All pieces in those letters, at once unless a zero in one of them hides where they end."""
        data = "\0".join(found).encode("utf-8", "replace")
        if data.count(0) != len(found) - 1:
            return list(map(named, found))
        return codes[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split(letters[0])

    def of_matches(found: list[str]) -> list[bytes]:
        return [packed([t.id for t in model.tokenize(name)]) for name in all_named(found)]

    pieces: dict[str, bytes] = {}

    def piece_ids(piece: str) -> bytes:
        known = pieces.get(piece)
        if known is None:
            known = pieces[piece] = packed(ids_of(piece))
        return known

    def of_words(words: list[str]) -> list[bytes]:
        if len(pieces) > 200_000:
            pieces.clear()
        found: dict[str, bytes] = {}
        others = []
        for word in words:  # of Latin-1 letters: normalising is lower-casing, and they are one piece
            if word.isalpha() and _latin(word):
                found[word] = packed(ids_of(named(word.lower())))
            else:
                others.append(word)
        for at in range(0, len(others), 2000):
            some = others[at : at + 2000]
            line = tokenizer.normalizer.normalize_str(" ".join(some))
            if line.count(" ") != len(some) - 1:  # a word that is no single word once normalised
                found.update((w, packed(tokenizer.encode(w, add_special_tokens=False).ids)) for w in some)
                continue
            ids_by_word: list[list[bytes]] = [[] for _ in some]
            starts = np.cumsum([0, *(len(w) + 1 for w in line.split(" "))])
            cut = tokenizer.pre_tokenizer.pre_tokenize_str(line)
            owners = np.searchsorted(starts, [span[0] for _, span in cut], side="right") - 1
            for (piece, _), owner in zip(cut, owners.tolist()):
                ids_by_word[owner].append(piece_ids(piece))
            found.update(zip(some, map(b"".join, ids_by_word)))
        return [found[w] for w in words]

    return Memo(of_matches, limit, pattern=pattern) if pattern else Memo(of_words, limit, cut=_small_word)


@functools.lru_cache(maxsize=4)
def _added(path: str) -> tuple[list[str], Callable[[str], bytes]]:
    """The strings of a file's added tokens, and the library's own encoding of a whole text."""
    tokenizer = _tokenizer(path)
    tokens = tokenizer.get_added_tokens_decoder().values()
    # one that is looked for in the normalized text may be written in other ways: any text may hold it
    names = [""] if any(t.normalized for t in tokens) else [t.content for t in tokens]

    def encode(text: str) -> bytes:
        tokenizer.encode_special_tokens = False
        try:
            return packed(tokenizer.encode(text, add_special_tokens=False).ids)
        finally:
            tokenizer.encode_special_tokens = True

    return names, encode


def text_ids(
    path: str, texts: list[str], cut: Callable[[str], list[str]], pattern: str | None = None, added_tokens: bool = False,
    limit: int = MEMO_BYTES,
) -> list[bytes]:
    """The ids of texts that ``cut`` parts into units. With ``added_tokens`` the strings of a file's added
    tokens become their ids, as in the library's default: texts that hold one are encoded whole."""
    memo = library_memo(path, pattern, limit)
    return _with_added(path if added_tokens else None, texts, lambda plain: memo.ids([cut(t) for t in plain]))


def byte_level_text_ids(path: str, texts: list[str], pattern: str, added_tokens: bool = False, limit: int = MEMO_BYTES) -> list[bytes]:
    """As :func:`text_ids` for a byte-level file, with the units of all texts looked up together."""
    memo = library_memo(path, pattern, limit)
    return _with_added(path if added_tokens else None, texts, lambda plain: memo.byte_level_ids(plain, pattern))


def _with_added(path: str | None, texts: list[str], ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    if not path:
        return ids_of(texts)
    names, encode = _added(path)
    whole = {i: encode(t) for i, t in enumerate(texts) if any(name in t for name in names)}
    found = iter(ids_of([t for i, t in enumerate(texts) if i not in whole]))
    return [whole[i] if i in whole else next(found) for i in range(len(texts))]
