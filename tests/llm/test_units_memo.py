"""The memo in front of a tokenizer."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from batchgauge.llm import batches, units


def test_units_new_to_several_lists():
    asked = []

    def encode(new):
        asked.extend(new)
        return [u.encode() + b"." for u in new]

    memo = units.Memo(encode)
    lists = [["a", "b"], ["b"], ["c", "a", "c"], [], ["b", "a"]]
    expected = [b"a.b.", b"b.", b"c.a.c.", b"", b"b.a."]
    assert memo.ids(lists) == expected and memo.ids(lists) == expected
    assert sorted(asked) == ["a", "b", "c"]


def test_one_tokenizer_for_words_and_added_tokens():
    """Both ways of encoding share the file's tokenizer, and ``forget`` lets it go."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    units.forget()
    texts = ["one <|endoftext|> two", "one two"]

    def cut(text):
        return units.byte_level_units(text, pattern)

    added = units.text_ids(path, texts, cut, pattern, added_tokens=True)
    plain = units.text_ids(path, texts, cut, pattern)
    assert units._tokenizer.cache_info().misses == 1
    assert added[1] == plain[1] and added[0] != plain[0] and len(added[0]) < len(plain[0])
    assert units.text_ids(path, texts, cut, pattern, added_tokens=True) == added
    units.forget()
    assert units._tokenizer.cache_info().currsize == 0


def test_frequent_units_outlive_a_full_memo():
    asked = []

    def encode(new):
        asked.extend(new)
        return [u.encode() + b"." for u in new]

    memo = units.Memo(encode, limit=4000)
    for i in range(100):
        assert memo.ids([["the", f"rare{i}"], ["the"]]) == [f"the.rare{i}.".encode(), b"the."]
    assert asked.count("the") == 1 and len(asked) == 101
    assert len(memo.known) + len(memo.older) < 30


def test_words_are_encoded_once_whatever_their_case_and_punctuation():
    asked = []

    def encode(new):
        asked.extend(new)
        return [u.encode() + b"." for u in new]

    memo = units.Memo(encode, cut=units._small_word)
    texts = ["Été été. ÉTÉ, été&&& Was was", "was. was,*** WAS!!"]
    found = memo.ids([units.small_units(t) for t in texts])
    assert found[0].decode() == "été.été...été.,.été.&&&.was.was."
    assert sorted(asked) == sorted(["été", "was", ".", ",", "&&&", ",***", "!!"])


def test_units_of_a_slice_are_looked_up_once(monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    texts = ["", "One two, one.\nTwo", "one  two\0", "two one, &&&! One\u3000\xa0é", "one two."] * 40
    units.forget()
    memo, asked = units.library_memo(path, pattern), []
    look = memo._ids_of_distinct
    monkeypatch.setattr(memo, "_ids_of_distinct", lambda found: asked.append(found) or look(found))
    library = Tokenizer.from_file(path)
    for _ in range(2):
        found = units.byte_level_text_ids(path, texts, pattern)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [library.encode(t).ids for t in texts]
    assert units.byte_level_text_ids(path, [], pattern) == []
    assert all(len(one) == len(set(one)) < 20 for one in asked)
    units.forget()


def test_distinct_units_outlive_a_full_memo():
    asked = []

    def encode(new):
        asked.extend(new)
        return [u.encode() + b"..."[: -len(u.encode()) % 4] for u in new]

    memo = units.Memo(encode, limit=4000, pattern=public_tokenizers.PATTERN)
    for i in range(100):
        assert memo.byte_level_ids([f"the&rare{i}", "the"], public_tokenizers.PATTERN)[1] == b"the."
    assert asked.count("the") == 1 and len(memo.known) + len(memo.older) < 50


def test_long_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(batches, "SHORT_TEXTS_BYTES", 100_000)
    rows = [str(i) * (1 if i < 3000 else 500) for i in range(4000)]
    parts = list(batches.long_slices([pa.RecordBatch.from_pydict({"text": rows})]))
    assert [t for part in parts for t in batches.texts(part)] == rows
    assert parts[0].num_rows == 2048 and max(p.num_rows for p in parts[1:]) == batches.ROWS_AT_ONCE


CHARACTERS = ["a", "É", "ß", "º", "µ", "×", "²", "½", "1", ".", ",", "'", "'S", "_", "&", " ", "  ", "\n", "\xa0", "\x85", "\x1d", "\0",
              "Σ", "İ", "日", "\u0301", "…", "٣", "the", "THE", " word", ". ", ", ", "<|endoftext|>", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("latin", [True, False])
@pytest.mark.parametrize("name, pattern, cut", [
    ("byte_bpe_50k.json", public_tokenizers.PATTERN, lambda t: units.byte_level_units(t, public_tokenizers.PATTERN)),
    ("word_bpe_49k.json", None, lambda t: units.small_units(t))])
def test_units_cut_at_stops_encode_like_whole_texts(name, pattern, cut, latin):
    path, pick = public_tokenizers.path(name), random.Random(5)
    letters = [c for c in CHARACTERS if units._latin(c)] if latin else CHARACTERS
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 12))) for _ in range(6000)]
    for added in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not added
        found = units.text_ids(path, texts, cut, pattern, added_tokens=added)
        for text, ids in zip(texts, found):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("latin", [True, False])
def test_units_looked_up_together_encode_like_whole_texts(latin):
    path, pattern, pick = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, random.Random(6)
    letters = [c for c in CHARACTERS if units._latin(c)] if latin else CHARACTERS
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 12))) for _ in range(6000)]
    for added in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not added
        for text, ids in zip(texts, units.byte_level_text_ids(path, texts, pattern, added)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
