"""Encoding over a trie of words against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from batchgauge.llm import prefixtrie, queries
from cases import DOCUMENTS, LONG, TEXTS, by_id, documents
from test_tokens import odd_texts

ADDED = [
    "x <|endoftext|> y", "<|startoftext|>a<|endoftext|><|endoftext|>", "<|endoftext|>", "a <|ENDOFTEXT|> b  <|endoftext|",
    "İstanbul ΣΑΣ ς", "we'll've'd aaaaaaaa'tis", "１２ Ⅷ ² ½ ª", "힣가 Å",
]


@pytest.fixture(scope="module")
def coder():
    return prefixtrie.Coder(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def word_texts(library, n, seed):
    pick, names = random.Random(seed), [t.replace("</w>", "") for t in sorted(library.get_vocab())]
    texts = ["".join(pick.choice(names) for _ in range(pick.randint(1, 5))) for _ in range(n)]
    return texts + ["".join(pick.choice("abcdehinorst") for _ in range(pick.randint(1, 40))) for _ in range(n)]


def test_ids_and_decoded_texts_equal_the_library(coder, library):
    texts = [t or "" for t in TEXTS] + ADDED + odd_texts(4000, 5) + word_texts(library, 3000, 6) + ["z" * 3000, "ab" * 2000]
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        for text, ids in zip(some, coder.encode(some)):
            ids, expected = np.frombuffer(ids, "<u4").tolist(), library.encode(text, add_special_tokens=False).ids
            assert ids == expected, repr(text)
            assert coder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_a_shared_prefix_is_worked_out_once(coder):
    trie = coder.trie
    trie.clear()
    trie.encode(["interest"])
    one = len(trie.last)
    assert one == len("interest") + 1  # the root, and a node for every prefix
    trie.encode(["interested", "interesting", "interests"])
    # 't' before another letter, then 'ed', 'ing' and 's' below it
    assert len(trie.last) == one + 1 + 2 + 3 + 1


def test_every_prefix_has_the_encoding_that_merging_gives(coder):
    trie, pick = coder.trie, random.Random(2)
    for _ in range(2000):
        word = "".join(pick.choice("abcdehinorst") for _ in range(pick.randint(1, 12)))
        assert trie.encode([word])[word] == trie.merged(trie.closed(word))


def test_the_trie_begins_anew_when_it_is_full(coder, monkeypatch):
    monkeypatch.setattr(prefixtrie, "NODES", 50)
    monkeypatch.setattr(prefixtrie, "PAIRS", 20)
    for word in ("remember", "dismember", "membership", "member"):
        assert coder.trie.encode([word, word + "s"])[word] == coder.trie.merged(coder.trie.closed(word))


def test_merges_without_word_ends():
    vocabulary = {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4, "bc": 5, "ca": 6}
    trie = prefixtrie.PrefixTrie(vocabulary, [("b", "c"), ("a", "b"), ("ab", "c"), ("c", "a")])
    assert "abc" not in trie.tokens  # its own letters merge to a, bc
    pick = random.Random(3)
    words = {"".join(pick.choice("abc") for _ in range(pick.randint(1, 9))) for _ in range(500)}
    assert all(ids == trie.merged(word) for word, ids in trie.encode(words).items())


def test_rows(spark, library, tmp_path):
    texts = TEXTS + ADDED + [LONG * 5]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(4, TEXTS[4], None, None, None), (None, "no id", None, None, None)]
    documents(spark, [r for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    found = by_id(queries.op12_prefix_trie(spark, str(tmp_path)))
    assert sum(map(len, found.values())) == len(rows) and len(found[4]) == 2 and len(found[None]) == 1
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        for row in found[i]:
            assert row["n_tokens"] == len(ids)
            assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    ids = by_id(prefixtrie.token_ids(documents(spark, rows), P.path("word_bpe_49k.json")))
    assert ids[5][0]["ids"] == library.encode(TEXTS[5], add_special_tokens=False).ids and ids[0][0]["ids"] == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert prefixtrie.encode_decode(empty, P.path("word_bpe_49k.json")).collect() == []
