"""Codes, packing and the transducer against the tokenizer libraries."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from batchgauge.llm import dac, packing, queries, transducer, units
from cases import DOCUMENTS, TEXTS, documents

LETTERS = ["a", "é", " ", "\n", "'s", "'", "日本", "\u0301", "😀", "1", "²", "\x1c", "\x85", "\xa0", " ", "\t", "\r\n", "the", "<|endoftext|>", "ß", "_", "-", ".", ", "]


def odd_texts(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, 30))) for _ in range(n)]


def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def byte_units(text):
    return units.byte_level_units(text, P.PATTERN)


@pytest.mark.parametrize("name, pattern, cut", [
    ("byte_bpe_50k.json", P.PATTERN, byte_units), ("word_bpe_49k.json", None, units.blank_separated_units)])
def test_units_encode_like_whole_texts(name, pattern, cut):
    texts, whole = [t or "" for t in TEXTS] + odd_texts(4000), library(name)
    memo = units.library_memo(P.path(name), pattern)
    for text, ids in zip(texts, memo.ids([cut(t) for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text), repr(text)


@pytest.fixture(scope="module")
def machine():
    ranks = transducer.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return transducer.Transducer(ranks), transducer.Decoder(ranks), tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_tiktoken(machine):
    coder, decoder, reference = machine
    for text in [t or "" for t in TEXTS[:-2]] + odd_texts(3000) + ["ab" * 4001, "the" * 3000, "aaab" * 999]:
        ids = [i for m in units.matches(text, P.PATTERN) for i in coder.encode(m.encode())]
        assert ids == reference.encode_ordinary(text)
        assert decoder.text(ids, 2) == text


def test_neighbours_stay_apart_as_merging_says(machine):
    coder, pick = machine[0], random.Random(1)
    for _ in range(5000):
        a, b = pick.randrange(4000), pick.randrange(4000)
        assert coder.stay_apart(a, b) == (coder.merged(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b])


def made_up_words(n, seed=2):
    pick, parts = random.Random(seed), ["th", "ing", "er", "on", "re", "é", "ção", "ent", "ña", "sh", "ble", "ou"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(3, 8))) for _ in range(n)]


def test_states_are_those_of_the_vocabulary(machine):
    """New words meet known states: a state is a trie node, whatever tokens came before."""
    coder = transducer.Transducer(machine[0].ranks)
    for word in made_up_words(3000, 2):
        coder.encode(word.encode())
    states, moves = len(coder.states), len(coder.moves)
    for word in made_up_words(3000, 4):
        assert coder.encode(word.encode()) == machine[2].encode_ordinary(word)
    assert len(coder.states) < 1.1 * states < 1000 and len(coder.moves) < 1.1 * moves


def test_transducer_with_small_tables(machine, monkeypatch):
    monkeypatch.setattr(transducer, "PAIRS", 20)
    monkeypatch.setattr(transducer, "MOVES", 30)
    coder = transducer.Transducer(machine[0].ranks)
    for text in made_up_words(300) + ["the" * 900, "日本ß" * 400]:
        assert coder.encode(text.encode()) == machine[2].encode_ordinary(text)
    assert coder.pairs <= 20 and len(coder.moves) <= 30


def test_streaming_decode_of_broken_bytes():
    data = "é日😀".encode() + b"\xff\xe6" + b"a" + "😀".encode()[:3]
    for step in (1, 2, 3):
        stream = transducer.Utf8Stream()
        parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(parts).replace("\ufffd", "") + stream.finish().replace("\ufffd", "") == "é日😀a"


def test_encode_decode_rows(spark, machine):
    found = transducer.encode_decode(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(found) == len(TEXTS) + 3 and all(r.decoded_ok for r in found)
    texts = dict((i * 3, t or "") for i, t in enumerate(TEXTS))
    for row in found:
        if row.doc_id is not None:
            ids = machine[2].encode_ordinary(texts[row.doc_id])
            assert row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_queries_read_added_tokens_like_the_library(spark, tmp_path):
    texts = [t or "" for t in TEXTS] + ["x <|endoftext|> y", "<|startoftext|>a<|endoftext|><|endoftext|>", "a <|ENDOFTEXT|> b  <|endoftext|"]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for query, name, end in ((queries.op3_addressable_codes, "byte_bpe_50k.json", 2), (queries.op8_packing, "word_bpe_49k.json", 1)):
        default = Tokenizer.from_file(P.path(name))
        found = {(r.doc_id, getattr(r, "start", 0)): r for r in query(spark, str(tmp_path)).collect()}
        assert {i for i, _ in found} == set(range(len(texts)))
        for (i, start), row in found.items():
            ids = default.encode(texts[i], add_special_tokens=False).ids + [end]
            if query is queries.op8_packing:
                assert row.doc_tokens == len(ids)
                ids = ids[start : start + row.length]
            else:
                assert row.n_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


# --- directly addressable codes -----------------------------------------------------


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (1000, 256), (5000, 70000), (513, 2**32 - 1)])
def test_codes_give_every_id(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    codes = dac.Codes(dac.pack(ids))
    assert len(codes) == n and codes.all().tolist() == ids.tolist()
    places = np.random.default_rng(1).permutation(n)[:300]
    assert codes.take(places).tolist() == ids[places].tolist()
    if n:
        assert codes[n - 1] == ids[-1]
    with pytest.raises(IndexError):
        codes[n]


def test_writers_look_up_units_of_many_rows_once(monkeypatch):
    asked, look = [], units.Memo._ids_of_distinct
    monkeypatch.setattr(units.Memo, "_ids_of_distinct", lambda memo, found: asked.append(found) or look(memo, found))
    rows = [f"the cat {'sat' if i % 2 else 'ran'}, on the <|endoftext|> mat" if i % 9 == 0 else "the cat sat, the" for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1999)], pa.int64()), "text": [None, *rows[1:]]})
    found = list(dac.encoded(iter([batch]), P.path("byte_bpe_50k.json"), P.PATTERN, True))
    default = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [i for i, _ in found] == [None, *range(1999)] and found[0][1] == b""
    assert all(np.frombuffer(ids, "<u4").tolist() == default.encode(t).ids for (_, ids), t in zip(found[1:], rows[1:]))
    assert len(asked) == 1 and len(asked[0]) < 10


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 64)
    files = dac.write(documents(spark), P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    found, whole = dac.documents_of(files).collect(), library("byte_bpe_50k.json")
    texts = dict((i * 3, t or "") for i, t in enumerate(TEXTS))
    assert len(found) == len(TEXTS) + 3
    ordered, at, stream = sorted(found, key=lambda r: r.start), 0, {}
    assert [r.doc_id for r in ordered[2:]] == sorted(r.doc_id for r in ordered[2:]) and ordered[0].doc_id is None
    for row in ordered:
        assert row.start == at
        at += row.n_tokens
        if row.doc_id is not None:
            ids = whole(texts[row.doc_id]) + [2]
            stream.update(enumerate(ids, row.start))
            assert row.n_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    places = [*sorted(stream)[:: max(1, len(stream) // 50)], at + 5, -1]
    asked = spark.createDataFrame([(p,) for p in places], "position BIGINT")
    answers = {r.position: r.id for r in dac.tokens_at(files, asked).collect()}
    assert answers == {p: stream[p] for p in places[:-2]}


def test_no_documents(spark):
    none = documents(spark, [])
    assert dac.documents_of(dac.write(none, P.path("byte_bpe_50k.json"), P.PATTERN, 2)).count() == 0
    assert packing.pack_documents(none, P.path("word_bpe_49k.json"), 1).count() == 0
    assert transducer.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- packing ------------------------------------------------------------------------


def test_closest_fill_against_all_subsets():
    pick = random.Random(5)
    for _ in range(300):
        lengths = [pick.randint(1, 30) for _ in range(pick.randint(1, 9))]
        capacity = pick.randint(1, 80)
        best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= capacity)
        counts = {n: lengths.count(n) for n in lengths}
        chosen = packing.closest_fill(counts, capacity)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(1 <= k <= counts[n] for n, k in chosen.items())


def whole_pieces(rows):
    """Every document is covered once, every window is gapless; returns the window lengths."""
    documents_seen, windows = {}, {}
    for doc, start, length, _, total, window, offset in rows:
        documents_seen.setdefault(doc, []).append((start, length, total))
        windows.setdefault(window, []).append((offset, length))
    for pieces in documents_seen.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == pieces[0][2]
    lengths = []
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    return lengths


@pytest.mark.parametrize("pool", [2, 50, 4096])
def test_packer_leaves_no_padding(pool):
    pick, packer = random.Random(pool), packing.Packer(0, 64, pool)
    for i in range(500):
        packer.add(i, bytes(4 * pick.choice([1, 2, 3, 5, 20, 63, 64, 65, 200])))
    packer.finish()
    lengths = whole_pieces(packer.rows)
    assert all(n & (n - 1) == 0 for n in lengths) and sum(n < 64 for n in lengths) <= 6


def test_pack_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)]
    found = packing.pack_documents(documents(spark, rows), P.path("word_bpe_49k.json"), 1).collect()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in whole_pieces([tuple(r) for r in found]))
    whole = library("word_bpe_49k.json")
    for row in found:
        ids = whole(TEXTS[row.doc_id] or "") + [1]
        assert row.doc_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids[row.start : row.start + row.length], "<u4").tobytes())


def test_schema_without_other_columns(spark):
    plain = documents(spark, [(1, "x", None, None, 1)], DOCUMENTS)
    assert packing.pack_documents(plain, P.path("word_bpe_49k.json"), 1).count() == 1
