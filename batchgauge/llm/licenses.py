"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

Texts are reduced to words (A-Z lower-cased; ASCII characters other than letters and digits part
words), so a phrase is found whatever stands between its words. One automaton reports every place
of every phrase, overlapping ones too. Behind an identifier tag the raw line is parsed as an
expression with ``AND``, ``OR``, ``WITH`` and parentheses and evaluated to a restrictiveness.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from batchgauge.llm.batches import id_and_text, per_slice, texts

# Phrases with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notices.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)

# How restrictive a licence family is, by the beginning of its identifier.
RESTRICTIVENESS = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "0bsd": 0.05,
    "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "zlib": 0.1,
    "cc-by": 0.2, "cc-by-sa": 0.5, "cc-by-nc": 0.7, "cc-by-nd": 0.7,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.4, "gpl": 0.6, "agpl": 0.7,
    "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.5
EXCEPTION = 0.75
"""``WITH`` an exception leaves this part of a licence's restrictiveness."""

WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words in order: runs of digits, a-z after lower-casing A-Z, and all characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE_PHRASES, **NOTICES, TAG: ""}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


# --- expressions --------------------------------------------------------------------

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.:+-]+|\S")


@dataclass(frozen=True)
class Value:
    restrictiveness: float
    identifiers: frozenset[str]


def restrictiveness(identifier: str) -> float:
    """That of the longest family whose name begins the identifier."""
    name = identifier.lower()
    families = [f for f in RESTRICTIVENESS if name == f or name.startswith(f + "-")]
    return RESTRICTIVENESS[max(families, key=len)] if families else UNKNOWN


def postfix(expression: str) -> list[str]:
    """Operands and operators in evaluation order (shunting-yard); ValueError if malformed."""
    out, stack, operand_next = [], [], True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in PRECEDENCE:
            if operand_next:
                raise ValueError(f"operator {token} without operand")
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError("( after operand")
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(") without operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(") without (")
            stack.pop()
        else:
            if not operand_next or not re.match(r"[A-Za-z0-9]", token):
                raise ValueError(f"unexpected {token}")
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError("unfinished expression")
    return out + stack[::-1]


def whole_part(tokens: list[str]) -> int:
    """How many tokens, from the first on, the longest whole expression takes; one pass, any length."""
    whole, depth, operand_next = 0, 0, True
    for i, token in enumerate(tokens, 1):
        if token.lower() in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        else:
            if not operand_next or not re.match(r"[A-Za-z0-9]", token):
                break
            operand_next = False
        if not operand_next and not depth:
            whole = i
    return whole


def evaluate(expression: str) -> Value:
    """``OR`` leaves the choice of the mildest, ``AND`` binds to the strictest, ``WITH`` softens."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix(expression):
        if token not in PRECEDENCE:
            stack.append((restrictiveness(token), {token.lower()}))
            continue
        (right, more), (left, names) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left * EXCEPTION, names))
            continue
        if len(more) > len(names):  # the smaller set goes into the larger, so long expressions stay cheap
            names, more = more, names
        names |= more
        stack.append(((min if token == "or" else max)(left, right), names))
    value, names = stack[0]
    return Value(value, frozenset(names))


def tagged(text: str) -> list[Value]:
    """The expressions behind identifier tags. Of a line that is no expression, the part up to the
    first word that does not fit counts."""
    found = []
    for match in _TAGGED.finditer(text):
        tokens = _TOKEN.findall(match[1])
        whole = whole_part(tokens)
        if whole:
            found.append(evaluate(" ".join(tokens[:whole])))
    return found


def scan_text(text: str) -> tuple:
    """Number of words, base places, first and last of them, base labels, all labels, score."""
    words = words_of(text)
    line = (b" %b " % b" ".join(words)).decode("latin-1")
    base_labels, labels, starts, score, has_tag = set(), set(), [], 0.0, False
    seen_to = seen_words = 0
    for end, (length, label, base) in automaton().iter(line):
        start = end - length + 1
        if not label:
            has_tag = True
            continue
        labels.add(label)
        score = max(score, restrictiveness(label))
        if base:
            if start >= seen_to:
                seen_words += line.count(" ", seen_to, start)
                seen_to = start
                place = seen_words
            else:
                place = seen_words - line.count(" ", start, seen_to)
            starts.append(place)
            base_labels.add(label)
    if has_tag:
        for value in tagged(text):
            labels |= value.identifiers
            score = max(score, value.restrictiveness)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
    )


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: counts, places, labels and ``score``, the restrictiveness (0: no notice).

    Null text counts as empty: no words, no labels, null places, score 0. Whole texts are scanned.
    """

    def rows(batch: pa.RecordBatch) -> list[list]:
        found = [scan_text(t) for t in texts(batch)]
        return [batch.column("doc_id").to_pylist(), *map(list, zip(*found))]

    ddl = (
        "doc_id BIGINT, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, "
        "base_labels STRING, labels STRING, score DOUBLE"
    )
    return per_slice(id_and_text(documents), ddl, rows)
