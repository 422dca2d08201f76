"""License scan, personal data and language identification."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from batchgauge.llm import ecoc, licenses, pii
from cases import TEXTS, by_id, documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_scan(text):
    words = WORDS.findall(lowered(text))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items()
              for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p for _, p in places}))


def test_scan_against_plain_search():
    pick = random.Random(2)
    parts = ["CC", "by", "cc-BY", "general", "Public", "LICENSE", "all", "rights reserved", "é", "x", "mit license", "Σ", "\n", "1"]
    texts = [" ".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(2000)] + [t or "" for t in TEXTS]
    for text in texts:
        found = licenses.scan_text(text)
        assert found[:5] == plain_scan(text)
        assert set(filter(None, found[4].split(","))) <= set(filter(None, found[5].split(","))) and 0 <= found[6] <= 1


@pytest.mark.parametrize("expression, order", [
    ("MIT", "MIT"), ("MIT OR Apache-2.0 AND ISC", "MIT Apache-2.0 ISC and or"),
    ("(MIT or Apache-2.0) AND ISC", "MIT Apache-2.0 or ISC and"),
    ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", "GPL-2.0+ Classpath-exception-2.0 with MIT or"),
])
def test_expressions(expression, order):
    assert " ".join(licenses.postfix(expression)) == order


@pytest.mark.parametrize("bad", ["", "AND", "MIT OR", "(MIT", "MIT)", "MIT ISC", "() MIT", "*"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


def test_tags_are_evaluated():
    found = licenses.scan_text("# SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND ISC */\ncode")
    assert found[5] == "gpl-3.0-only,isc,mit" and found[6] == pytest.approx(0.1)
    assert licenses.scan_text("SPDX-License-Identifier: nothing ( useful")[5] == "nothing"
    assert licenses.evaluate("GPL-2.0 WITH x").restrictiveness < licenses.restrictiveness("GPL-2.0")


@pytest.mark.parametrize("shape", ["{} */ code", "({}) -->", "{} and so on, as written above"])
def test_long_expressions_are_read_whole(shape):
    names = [f"own-{i}" for i in range(5000)] + ["GPL-3.0-only"]
    found = licenses.scan_text("SPDX-License-Identifier: " + shape.format(" AND ".join(names)))
    assert set(names[:-1]) | {"gpl-3.0-only"} <= set(found[5].split(",")) and found[6] == pytest.approx(0.6)


def test_whole_parts_against_every_prefix():
    pick = random.Random(8)
    for _ in range(3000):
        tokens = [pick.choice(["MIT", "ISC", "AND", "or", "WITH", "(", ")", "*", "x"]) for _ in range(pick.randint(0, 12))]
        whole = 0
        for n in range(1, len(tokens) + 1):
            try:
                licenses.postfix(" ".join(tokens[:n]))
                whole = n
            except ValueError:
                pass
        assert licenses.whole_part(tokens) == whole


def test_scan_rows(spark):
    found = by_id(licenses.scan(documents(spark)))
    assert sum(map(len, found.values())) == len(TEXTS) + 3
    assert found[0][0]["n_words"] == 0 and found[0][0]["first_word"] is None and found[0][0]["labels"] == ""
    assert licenses.scan(documents(spark, [])).count() == 0


# --- personal data ------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sums_up(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    keep = [
        (EMAIL, lambda m: True), (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        (CARD, lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and sums_up(re.sub("[^0-9]", "", m))),
        (PHONE, lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(keep) for m in p.finditer(text) if ok(m[0])]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans_against_the_patterns():
    pick = random.Random(4)
    parts = ["a@b.c", "@", "@x.y", ".", "-", "+1", "555", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", " ", "é", "(", ")", "x_%", "001.002.3.4", "b.c", "12", "\n", "٣"]
    for _ in range(6000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "@" * 300_000):
        pii.base_spans(text)


def test_rows_and_added_spans(spark):
    sure = "Mail ann.lee@mail.example.com now. "
    texts = [*TEXTS, *[f"{sure}word word {i} words here call +1 (555) 123-4567 or 4111111111111111 from 10.0.0.{i}" for i in range(40)],
             f"{sure} Later text here says <ann.lee@mail> again, ask ann.lee@mail.example.com there"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    found = by_id(pii.find(documents(spark, rows)))
    for i, text in enumerate(texts):
        base, row = plain_spans(text or ""), found[i][0]
        assert row["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(row["spans"].split(","))
        assert row["n_email"] == sum(k == "email" for _, _, k in base)
        if not base:
            assert row["spans"] == ""
    assert found[None][0]["spans"] == ""
    assert pii.find(documents(spark, [])).count() == 0


def test_skip_edges_carry_a_label():
    """A token the features leave open follows a sure one that repeats it, and not without it."""
    n = len(pii.KINDS) + 1
    field = pii.Field(np.zeros((pii.FEATURES, n)), np.zeros((n, n)), np.where(np.eye(n), 3.0, -3.0))
    graph = pii.graph("id 12345678 is here and much later on once more 12345678 stands")
    assert len(graph.skip) == 1
    a, b = graph.skip[0]
    open_ = field.marginals(graph)
    assert np.allclose(open_, 1 / n)
    field.weights[graph.features[a][0], 3] = 8
    graph.features[b] = [0] * len(graph.features[b])
    assert field.marginals(graph)[b].argmax() == 3
    graph.skip = graph.skip[:0]
    assert field.marginals(graph)[b].max() < 0.5


@pytest.mark.parametrize("lean", [0.0, -4.0])
def test_a_clear_form_reaches_all_that_repeat_it(lean):
    """Plain forms far from the one clear form are labelled like the near ones, even where each leans against it."""
    n = len(pii.KINDS) + 1
    field = pii.Field(np.zeros((pii.FEATURES, n)), np.zeros((n, n)), np.where(np.eye(n), 3.0, -3.0))
    text = "Call +1 555 012 3456 or +15550123456 and then " + " ".join(f"word 15550123456 more{'x' * (i % 3)} words" for i in range(400))
    base, found = pii.base_spans(text), pii.graph(text)
    for i, (a, b) in enumerate(found.spans):
        if text[a:b] == "15550123456":
            field.weights[found.features[i][0], 1:] = lean / 2
    spans = pii.added_spans(text, base, field)
    assert [k for _, _, k in base] == ["phone"] * 2
    plain = [(m.start(), m.end()) for m in re.finditer(r"(?<=word )15550123456", text)]
    assert [(a, b) for a, b, _ in spans] == plain and {k for _, _, k in spans} == {"phone"}
    assert len(found.skip) <= len(plain) + 3


def test_nodes_to_learn_from_come_from_the_whole_document():
    short, long = (pii.graph(" ".join(f"word {i} {i % 50}0000000" for i in range(n))) for n in (20, 3000))
    nodes, chain, pairs = pii.drawn(short)
    assert len(nodes) == len(short.spans) and chain.tolist() == short.chain.tolist() and pairs.tolist() == short.pairs.tolist()
    nodes, chain, pairs = pii.drawn(long)
    n = len(long.spans)
    assert n > 6000 and pii.NODES_LEARNED - pii.RUN <= len(nodes) <= pii.NODES_LEARNED
    assert all(((nodes >= n * q // 4) & (nodes < n * (q + 1) // 4)).any() for q in range(4))
    assert {tuple(e) for e in nodes[chain].tolist()} == {(a, b) for a, b in long.chain.tolist() if {a, b} <= set(nodes.tolist())}
    assert {tuple(e) for e in nodes[pairs].tolist()} <= {tuple(e) for e in long.pairs.tolist()} and len(chain)


def test_redaction(spark):
    text = "a x@y.zz b 1.2.3.4"
    assert pii.redact(text, pii.base_spans(text)) == "a [EMAIL] b [IP]"
    docs = documents(spark, [(1, text, "en", "s", len(text)), (2, None, None, None, 7), (3, "clean", None, None, 5)])
    found = by_id(pii.redacted(docs))
    assert pii.redacted(docs).columns == docs.columns
    assert found[1][0]["text"] == "a [EMAIL] b [IP]" and found[1][0]["n_chars"] == 16
    assert found[2][0]["text"] is None and found[2][0]["n_chars"] == 7 and found[3][0]["text"] == "clean"


# --- languages ----------------------------------------------------------------------


def invented(lang, pick):
    syllables = {"en": ["the", "ing", "and", "er"], "de": ["ich", "und", "ung", "ein"], "fr": ["eau", "que", "les", "é"]}[lang]
    return " ".join("".join(pick.choice(syllables) for _ in range(pick.randint(1, 3))) for _ in range(30))


def test_held_out_accuracy(spark):
    pick = random.Random(6)
    rows = [(i, invented(("en", "de", "fr")[i % 3], pick), ("en", "de", "fr")[i % 3], None, None) for i in range(300)]
    rows += [(1000, None, "en", None, None), (1001, "12 !", "en", None, None), (None, "the ing and the", None, None, None), rows[0]]
    found = ecoc.identify(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    rest = by_id(ecoc.identify(documents(spark, rows)))
    assert rest[1000][0]["lang_pred"] == rest[1001][0]["lang_pred"] == "und" and rest[None][0]["lang_pred"] == "en"
    assert all(0 <= r.score <= 1 for r in found)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)


def test_nothing_to_learn_from(spark):
    assert ecoc.identify(documents(spark, [])).count() == 0
    found = ecoc.identify(documents(spark, [(1, "words", None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7, 8, 30])
def test_codewords_differ(n):
    words = ecoc.codewords(n)
    assert words.shape[0] == n and len({tuple(w) for w in words}) == n


def test_numerals_are_no_letters(spark):
    pick = random.Random(8)
    rows = [(i, invented(("en", "de")[i % 2], pick), ("en", "de")[i % 2], None, None) for i in range(40)]
    odd = {100: "²", 101: "½ Ⅷ ٤", 102: "Ⓐ _", 103: "ª", 104: "漢"}
    found = by_id(ecoc.identify(documents(spark, rows + [(i, t, None, None, None) for i, t in odd.items()])))
    assert [found[i][0]["lang_pred"] == "und" for i in odd] == [True, True, True, False, False]
    kept = ecoc.determined(documents(spark, [(i, t, None, None, None) for i, t in odd.items()]))
    assert sorted(r.doc_id for r in kept.collect()) == [103, 104]


@pytest.mark.parametrize("few", range(6))
def test_a_language_of_one_document_is_learned(spark, few):
    """Whatever fold its only labelled document falls in, if it is not held out."""
    pick = random.Random(few)
    rows = [(i, invented(("en", "de")[i % 2], pick), ("en", "de")[i % 2], None, None) for i in range(40)]
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5]
    rows.append((ids[few], invented("fr", pick), "fr", None, None))
    assert ecoc.train(documents(spark, rows)).languages == ["de", "en", "fr"]


def test_many_base_spans_in_one_text_take_linear_time():
    n = len(pii.KINDS) + 1
    field = pii.Field(np.zeros((pii.FEATURES, n)), np.zeros((n, n)), np.where(np.eye(n), 3.0, -3.0))
    text = " ".join(f"user{i}@mail.example.org and user{i}@mail here" for i in range(20_000))
    base, started = pii.base_spans(text), time.perf_counter()
    spans = pii.added_spans(text, base, field)
    assert len(base) == 20_000 and time.perf_counter() - started < 120
    assert {text[a:b] for a, b, _ in spans} <= {f"user{i}@mail" for i in range(20_000)}


def test_a_token_may_hold_many_base_spans():
    text = "10.0.0.1,10.0.0.2,10.0.0.3,10.0.0.4,averylongmailaddressindeed@subdomain.mail.example.org,10.0.0.5"
    found, base = pii.graph(text), pii.base_spans(text)
    assert len(base) == 6 and pii.labels_of(found, base) == [1 + pii.KINDS.index("email")]


def test_marginals_of_a_tree_are_exact():
    """Sum-product on a chain with one skip edge that closes no loop equals the sum over all labellings."""
    n, rng = len(pii.KINDS) + 1, np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(pii.FEATURES, n)), rng.normal(size=(n, n)), rng.normal(size=(n, n)))
    field.skip = (field.skip + field.skip.T) / 2
    found = pii.Graph([(0, 1)] * 4, np.array([True] * 4), np.array([[0, 1], [2, 3]]), np.array([[1, 2]]), np.zeros((0, 2), np.int64), [[i, i + 7] for i in range(4)])
    single = np.array([field.weights[f].sum(0) for f in found.features])
    total = np.zeros((4, n))
    for labels in itertools.product(range(n), repeat=4):
        score = sum(single[i, x] for i, x in enumerate(labels)) + field.chain[labels[0], labels[1]] + field.chain[labels[2], labels[3]] + field.skip[labels[1], labels[2]]
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    assert np.allclose(field.marginals(found)[:4], total / total.sum(1, keepdims=True), atol=0.01)
