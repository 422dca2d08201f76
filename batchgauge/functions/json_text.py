"""Configuration documents as JSON text: replacing the version, and a digest, for documents of any shape.

SQL functions cannot change one value and keep the rest of a text as it is written; these small
Arrow functions can. Differences need no Python, see ``operators.options``.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^\[\]{}",:\s]+', re.DOTALL)


def _value_end(text: str, at: int) -> int:
    """Where the value that begins at ``at`` ends, however deeply it is nested."""
    depth = 0
    for token in _TOKEN.finditer(text, at):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(token[0], 0)
        if depth == 0:
            return token.end()
    raise ValueError("unfinished value")


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except RecursionError:  # nested too deeply for the parser: the braces have to be in pairs at least
        start = _BLANK.match(text).end()
        return text[start] == "{" and not text[_value_end(text, start) :].strip()


def versioned(text: str | None, version: str | None) -> str | None:
    """The same text with its top-level version replaced, or added in front; nothing else changes.

    NULL for NULL and for text that is no JSON object.
    """
    if text is None or version is None:
        return None
    decode = json.JSONDecoder()
    out, kept, found = [], 0, False
    try:
        if not _is_object(text):
            return None
        at = _BLANK.match(text).end() + 1
        first = at
        while True:
            at = _BLANK.match(text, at).end()
            if text[at] == "}":
                break
            if text[at] == ",":
                at = _BLANK.match(text, at + 1).end()
            key, at = decode.raw_decode(text, at)
            start = _BLANK.match(text, _BLANK.match(text, at).end() + 1).end()
            at = _value_end(text, start)
            if key == "version":
                out += [text[kept:start], version]
                kept, found = at, True
        if found:
            return "".join([*out, text[kept:]])
        empty = text[_BLANK.match(text, first).end()] == "}"
        return f'{text[:first]}"version": {version}{"" if empty else ", "}{text[first:]}'
    except (ValueError, IndexError):
        return None


def canonical_sha256(text: str | None) -> str | None:
    """SHA-256 of a document with sorted keys, so neither their order nor blanks count; of one nested too
    deeply for the parser the digest of the text; NULL for NULL and for text that is no JSON."""
    if text is None:
        return None
    try:
        text = json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
    except RecursionError:
        pass
    except ValueError:
        return None
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.StringType())
def json_with_version(text: pd.Series, version: pd.Series) -> pd.Series:
    return pd.Series([versioned(t, v) for t, v in zip(text, version)], dtype=object)


@F.pandas_udf(T.StringType())
def json_sha256(text: pd.Series) -> pd.Series:
    return pd.Series([canonical_sha256(t) for t in text], dtype=object)
