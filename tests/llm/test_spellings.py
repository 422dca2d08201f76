"""Spelling variants against edit distances of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from batchgauge.llm import queries, spellings
from cases import DOCUMENTS, LONG, TEXTS, documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_words(n, letters, lengths, seed):
    """Words and edits of them, with counts that differ by factors."""
    pick, found = random.Random(seed), {}
    while len(found) < n:
        word = "".join(pick.choice(letters) for _ in range(pick.choice(lengths)))
        for _ in range(pick.randint(0, 4)):
            found.setdefault(word, pick.choice([5, 6, 25, 30, 125, 700, 4000]))
            at = pick.randrange(len(word) + 1)
            word = pick.choice([word[:at] + word[at + 1 :], word[:at] + pick.choice(letters) + word[at:],
                                word[:at] + pick.choice(letters) + word[at + 1 :]])
            word = word if len(word) >= 6 else word + pick.choice(letters) * 2
    return found


def plain_near(words):
    found = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            found[w] = len(near), words[best], best
    return found


@pytest.mark.parametrize("letters, lengths, parts, cells", [
    ("ab", (6, 7, 8), 3, 1 << 16), ("ab", (6, 7, 8), 2, 1 << 16), ("ab", (6, 7), 3, 60), ("abc", (9, 12, 20), 4, 40),
    ("abcdefghé", (6, 7, 9, 11), 3, 1 << 16), ("a", (6, 7, 8, 9, 40, 41), 3, 1 << 16)])
def test_near_words_are_all_single_edits(spark, letters, lengths, parts, cells):
    words = random_words(12 if letters == "a" else 260, letters, lengths, len(letters) + parts) if letters != "a" else {
        "a" * n: n * n for n in (6, 7, 8, 9, 40, 41, 43)}
    frame = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")
    found = {r.word: (r.n_near, r.best_n, r.best) for r in spellings.near_words(frame, parts, cells).collect()}
    assert found == plain_near(words)


def test_tiles_of_one_large_group(monkeypatch):
    monkeypatch.setattr(spellings, "TILE_CELLS", 400)
    words = list(random_words(150, "ab", (9, 10), 5))
    counts, expected = dict.fromkeys(words, 1), {}
    found = spellings.Neighbours()
    for m in {len(w) for w in words} | {len(w) + 1 for w in words}:
        some = [w for w in words if len(w) in (m, m - 1)]
        halves = some[::2], some[1::2]
        for part in halves:
            found.group(m, 0, part, [1] * len(part), None, 1)
        if halves[1]:
            found.group(m, 0, halves[0], [1] * len(halves[0]), (halves[1], [1] * len(halves[1])), 1)
    found.flush(1)
    for w, (n, _, best) in plain_near(counts).items():
        expected[w] = [n, 1, best]
    assert found.found == expected


def test_matrices_give_common_prefixes_and_suffixes():
    block = spellings.Block(["abcdef", "abcxdef", "bcdefg", "abcdeg"], 7)
    near, prefix = spellings.single_edits(block, block)
    assert prefix[0].tolist() == [7, 3, 0, 5] and near[0].tolist() == [False, True, False, False]
    assert np.array_equal(near, near.T)


def test_words_of_a_document():
    text = "Straße ÄRGER naïveté×÷ ab-cd日本ef ŒUVRE İx İÀÿ"
    for doc_id in (None, 0, 7, 10**12, -3):
        expected = Counter()
        for word, n in plain_words([(doc_id, f"{text} " * 5)] ).items():
            expected[word] = n
        assert {w: n for w, n in spellings.words_of(doc_id, f"{text} " * 5, 6).items() if n >= 5} == expected
    every = spellings.words_of(1, "abcdefgh abc", 1, 1)
    assert sorted(map(len, every)) == [2, 7]


def test_chains_of_forms(spark):
    chain = ["mannered", "manneret", "mannerets", "mannerest", "banneret", "bannerets", "bannerots"]
    words = {w: 5 ** (i + 1) for i, w in enumerate(reversed(chain))} | {"solitude": 9, "zzzzzz": 5, "zzzzzza": 25, "zzzzzzb": 25}
    rows, doc_id = [], 0
    for word, n in words.items():
        while zlib.crc32(f"{doc_id}:{word}".encode()) % 199 == 0:
            doc_id += 1
        rows.append((doc_id, f"{word} " * n))
    found = rows_of(spellings.variants(documents(spark, [(i, t, None, None, None) for i, t in rows])))
    assert found == plain_variants(plain_words(rows))
    root = {w: (form, root) for w, form, root, *_ in found}
    assert root["bannerots"] == ("bannerets", "mannered") or root["bannerots"][1] != "bannerots"
    assert root["zzzzzz"][0] == "zzzzzza" and root["solitude"] == (None, "solitude")


def test_rows(spark, tmp_path):
    pick, names = random.Random(1), [*random_words(80, "abcdé", (6, 7, 8), 3), "Lorem", "CONSECTETUR", "consectetúr"]
    texts = [" ".join(pick.choices(names, [1 / (i + 1) for i in range(len(names))], k=400)) for _ in range(30)]
    rows = list(enumerate([*TEXTS, *texts, LONG.upper(), "x" * 70000 + " " + "x" * 70001])) + [(None, None), (None, texts[0]), (3, TEXTS[3])]
    rows += [rows[20]] * 6 + [(900 + i, "y" * 5000 + " " + "y" * 5001) for i in range(6)]
    documents(spark, [(i, t, None, None, None) for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(queries.op13_spelling_variants(spark, str(tmp_path))) == plain_variants(plain_words(rows))


def test_empty_table(spark):
    assert spellings.variants(spark.createDataFrame([], DOCUMENTS)).collect() == []
    assert spellings.variants(documents(spark, [(1, None, None, None, None), (2, "short words", None, None, None)])).collect() == []
