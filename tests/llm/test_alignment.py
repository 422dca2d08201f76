"""Aligned tokenizations against a plain walk over the byte offsets of both."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from batchgauge.llm import alignment, queries
from cases import DOCUMENTS, LONG, TEXTS, by_id, documents
from test_tokens import odd_texts

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
MORE = [
    "a▁b", "▁", " lead", "trail ", "  two  blanks  ", "\n\nlines\n", "<s> x </s> <0x41> <unk>", "a <|endoftext|> b", "\x00", "é" * 50,
    "naïve café", "ﬁ Å １２", "日本 日本 日本", "x" * 3000, "unbelievably antidisestablishmentarianism", "A B C A B C",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*FILES)


class Plain:
    """Whole texts by the libraries, groups and links by comparing every pair of offsets."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
        self.a.encode_special_tokens = True
        letters = alignment.byte_letters()
        self.byte_of = {c: i for i, c in enumerate(letters)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte_of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        data = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in side) == data for side in (a, b)) else ([], [])

    def aligned(self, text):
        a, b = self.tokens(text)
        ends = []
        for side in (a, b):
            at, found = 0, []
            for _, token in side:
                at += len(token)
                found.append(at)
            ends.append(found)
        links = [(x[0], y[0]) for x, p in zip(a, ends[0]) for y, q in zip(b, ends[1]) if p == q]
        cuts, groups, begin = sorted(set(ends[0]) & set(ends[1])), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t, e in zip(side, end) if begin < e <= cut) for side, end in zip((a, b), ends)))
            begin = cut
        return len(a), len(b), groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_tokens_groups_and_links(aligner, plain):
    texts = [t for t in TEXTS[:-2]] + MORE + odd_texts(1500, 9)
    tokens = aligner.tokenised(texts)
    for text, ids, (groups, links) in zip(texts, tokens, aligner.align(tokens)):
        n_a, n_b, expected, pairs = plain.aligned(text)
        assert (len(ids[0]) // 4, len(ids[1]) // 4) == (n_a, n_b), repr(text)
        assert groups.decode() == ";".join(expected), repr(text)
        held = aligner.pairs[alignment.np.frombuffer(links, "<u4")]
        assert [(p >> 32, p & 0xFFFFFFFF) for p in held.tolist()] == pairs
    assert sum(not ids[0] for ids in tokens) >= 4  # null, empty, and a space mark in the text


def test_words_cut_before_encoding_give_the_ids_of_whole_texts(aligner, plain):
    texts = [" ".join(odd_texts(40, seed)) for seed in range(60)] + [LONG + "  " + LONG]
    for text, (_, ids) in zip(texts, aligner.tokenised(texts)):
        assert not ids or alignment.np.frombuffer(ids, "<u4").tolist() == plain.b.encode(text)
    assert sum(bool(ids) for _, ids in aligner.tokenised(texts)) == len(texts)


def test_windows_end_at_anchors_and_are_remembered(aligner):
    aligner.windows.clear()
    aligner.align([aligner.tokens("one two three one two three one two three")])
    assert len(aligner.windows) == 3
    for key in aligner.windows:
        ids = alignment.np.frombuffer(key, "<u4")
        a, b = (ids[side].tobytes() for side in (ids < alignment._OF_B, ids >= alignment._OF_B))
        b = (alignment.np.frombuffer(b, "<u4") - alignment._OF_B).tobytes()
        spelled = [b"".join(side[i] for i in alignment.np.frombuffer(ids, "<u4")) for side, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
        assert spelled[0] == spelled[1] and spelled[0].startswith(b" ") and b" " not in spelled[0][1:]


def test_few_windows_are_remembered_where_memory_is_short(plain):
    small = alignment.Aligner(*FILES, limit=1000)
    texts = odd_texts(200, 4)
    for text, (groups, _) in zip(texts, small.align(small.tokenised(texts))):
        assert groups.decode() == ";".join(plain.aligned(text)[2])


def test_frequent_windows_outlive_a_full_memory(monkeypatch):
    made = []
    plain = alignment.Aligner._aligned
    monkeypatch.setattr(alignment.Aligner, "_aligned", lambda self, keys: made.extend(keys) or plain(self, keys))
    small = alignment.Aligner(*FILES, limit=8000)
    small.align([small.tokens("the")])
    (key,) = made
    for i in range(60):
        small.align([small.tokens(f"the rare{i}x the")])
    assert len(made) > 60 and made.count(key) == 1
    assert len(small.windows) + len(small.older) < 40


def test_pieces_are_cut_at_stops_behind_words_only(aligner):
    words = aligner.pieces._words
    assert words(" One two. Three, 4.5 x,%%") == [" One", " two", ".", " Three", ",", " 4", ".5", " x", ",%%"]
    for text in (" a ².", " one. ². two.", " wait... one.", " one .", " one).", "  one.", " one.\0"):
        assert "." not in words(text) and "".join(words(text)) == text
    assert aligner.pieces.glued == {"²."}


def test_pairs_hold_all_that_can_be_linked(aligner):
    pairs = {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in aligner.pairs}
    assert len(pairs) < sum(map(len, aligner.bytes_a)) + 2 * sum(map(len, aligner.bytes_b))
    for a in range(0, 50000, 371):
        for b in range(3, 32000, 97):
            x, y = aligner.bytes_a[a], aligner.bytes_b[b]
            assert ((a, b) in pairs) == (x.endswith(y) or y.endswith(x))


def expected_rows(plain, rows):
    found = [(doc_id, *plain.aligned(text)) for doc_id, text in rows]
    count = Counter(link for *_, links in found for link in links)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (repr(doc_id), n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, groups, links in found)


def test_rows(spark, plain, tmp_path):
    texts = [t for t in TEXTS[:-2]] + MORE + odd_texts(100, 8)
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, TEXTS[4]), (None, "no id here"), (None, None)]
    documents(spark, [(i, t, None, None, None) for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_token_alignment(spark, str(tmp_path))
    assert sorted(
        (repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()
    ) == expected_rows(plain, rows)


def test_groups_and_counts(spark, plain):
    docs = documents(spark, [(1, "the cat", None, None, None), (2, "the hat", None, None, None)])
    groups = by_id(alignment.groups(docs, *FILES))
    assert groups[1][0]["groups"] == ";".join(plain.aligned("the cat")[2])
    counts = {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(alignment.linked(docs, *FILES), *FILES).collect()}
    assert counts == Counter(x for t in ("the cat", "the hat") for x in plain.aligned(t)[3])


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCUMENTS), *FILES).collect() == []
    nothing = documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert sorted(tuple(r) for r in alignment.align(nothing, *FILES).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
