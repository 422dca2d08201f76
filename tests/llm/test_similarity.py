"""Fingerprints, components, URL rules and vectors against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash

from batchgauge.llm import covertree, crosspolytope, queries, simhash, urls
from batchgauge.llm.components import components
from cases import TEXTS, by_id, documents, embeddings


def plain_components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(900, i) for i in range(901, 960)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    label = plain_components({n for e in real for n in e}, real)
    assert all(found.get(n, n) == c for n, c in label.items())
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in TEXTS[:14]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text or "")
    assert simhash.fingerprint("") == 0
    short = TEXTS[-1][:2000]
    assert simhash.fingerprint(short) == plain_fingerprint(short)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def near(values, most=3):
    diff = np.bitwise_count(values[:, None] ^ values[None])
    return {(i, j) for i, j in zip(*np.nonzero(diff <= most))}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, max(2, n // 20), dtype=np.uint64)
    values = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    return np.unique(values)


@pytest.mark.parametrize("n", [1, 5, 16, 17, 300, 1500])
def test_gray_index_finds_all(n):
    values = clustered(n, n)
    q, v = simhash.GrayIndex(values).search(values)
    assert set(zip(q.tolist(), v.tolist())) == near(values)


def test_gray_rank_orders_the_gray_sequence():
    codes = np.array([i ^ i >> 1 for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


@pytest.mark.parametrize("group", [20, 4096])
def test_links_connect_what_brute_force_connects(spark, group):
    values = clustered(900, 9)
    signed = values.view(np.int64)
    links = simhash.links(spark.createDataFrame([(int(v),) for v in signed], "fp BIGINT"), group).collect()
    place = {int(v): i for i, v in enumerate(signed)}
    found = [(place[r.a], place[r.b]) for r in links]
    truth = near(values)
    assert len(found) < 8 * len(values)  # forests, not all pairs
    nodes = range(len(values))
    assert plain_components(nodes, found) == plain_components(nodes, truth)


def test_the_index_leaves_out_most_pairs():
    """Runs are dropped by the differences added up above them, in groups of the size the operator makes."""
    rng = np.random.default_rng(3)
    for values in (clustered(2 * simhash.GROUP, 11), rng.integers(0, 2**64, simhash.GROUP, dtype=np.uint64)):
        index = simhash.GrayIndex(values)
        index.search(values)
        assert index.compared < 0.1 * len(values) ** 2
    index = simhash.GrayIndex(values[:2])
    index.search(values[:2])
    assert index.compared in (2, 4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_groups_of_the_given_documents_are_searched_by_the_index(spark):
    """On sf0.1: the share of pairs compared in the groups that are searched, and the links of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    prints = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64)).view(np.uint64)
    bits = int(np.ceil(np.log2(len(prints) / simhash.GROUP)))
    compared = pairs = 0
    for block in range(4):
        keys = prints >> np.uint64(16 * (block + 1) - bits) & np.uint64((1 << bits) - 1)
        for key in np.unique(keys):
            own = prints[keys == key]
            index = simhash.GrayIndex(own)
            index.search(own)
            compared, pairs = compared + index.compared, pairs + len(own) ** 2
    assert bits >= 1 and compared < 0.1 * pairs
    place = {int(v): i for i, v in enumerate(prints.view(np.int64))}
    edges = simhash.links(spark.createDataFrame([(v,) for v in place], "fp BIGINT")).collect()
    truth = set()
    for at in range(0, len(prints), 1000):
        i, j = np.nonzero(np.bitwise_count(prints[at : at + 1000, None] ^ prints[None]) <= 3)
        truth |= {(a + at, b) for a, b in zip(i.tolist(), j.tolist()) if a + at < b}
    nodes = range(len(prints))
    assert plain_components(nodes, [(place[r.a], place[r.b]) for r in edges]) == plain_components(nodes, truth)


def test_near_duplicate_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], None, None, None), (None, "alone here", None, None, None)]
    found = by_id(simhash.near_duplicates(documents(spark, rows)))
    prints = np.array([simhash.fingerprint(t or "") for t in TEXTS], np.uint64)
    label = plain_components(range(len(TEXTS)), near(prints))
    for i in range(len(TEXTS)):
        assert {(r["fingerprint"], r["component_id"]) for r in found[i]} == {(f"{int(prints[i]):016x}", label[i])}
    assert len(found[7]) == 2 and found[None][0]["component_id"] is None
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- URLs ---------------------------------------------------------------------------

PLAIN_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for h, p, v in PLAIN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


def test_urls(spark):
    hosts = ["a.example.net", "EXAMPLE.net", "net", "x.org", "org", "www.example.com", "example.com", "other.com", "notexample.com", "İ.net", ""]
    paths = ["/", "", "/en/1", "/de/2.html", "/fr/3?x=1", "/FR/4", "?q", "#f", "/en", "/de/\n5", "//x://y"]
    urls_ = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c/fr/"]
    rows = [(i, u, "h", "r", "i") for i, u in enumerate(urls_)] + [(None, urls_[0], None, None, None), (0, urls_[0], "h", "r", "i")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, rules STRING, index STRING")
    found = by_id(urls.judge(pages), "page_id")
    for i, url in enumerate(urls_):
        host, path, rule, verdict = plain_judge(url)
        row = found[i][0]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), url
        assert row["verdict"] == verdict if rule else row["verdict"] in ("allow", "block")
    assert len(found[0]) == 2 and len(found[None]) == 1
    assert urls.judge(pages.where("false")).count() == 0


def test_mined_rules_match_by_all_their_tokens(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a"], "allow")] * 30 + [(["b"], "allow")] * 30 + [(["c", "a"], "allow")] * 10
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, verdict STRING")
    mined = urls.mine(labelled, 0.05, 0.7)
    kept = {(tuple(r.tokens), r.verdict) for r in mined.collect()}
    assert (("a", "b"), "block") in kept and (("c",), "allow") in kept
    assert (("a", "c"), "allow") not in kept  # a shorter rule says so as surely
    index = urls.inverted_index(mined).first()
    assert sorted(index["index"]) == ["a", "b", "c"] or set(index["index"]) >= {"a", "b", "c"}


def test_rules_match_tokens_anywhere_in_a_url(spark):
    filler = "/".join(f"x{i}" for i in range(20))
    rows = [(i, f"http://example.com/de/{i}") for i in range(20)] + [(100 + i, f"http://a.org/fr/{i}") for i in range(20)]
    rows += [(200, f"http://other.com/{filler}/de/1"), (201, f"http://other.com/{filler}/it/1")]
    found = by_id(urls.judge(spark.createDataFrame(rows, "page_id BIGINT, url STRING")), "page_id")
    assert (found[200][0]["verdict"], found[200][0]["source"]) == ("block", "mined")
    assert (found[201][0]["verdict"], found[201][0]["source"]) == ("allow", "default")


def test_learned_tokens_are_the_frequent_ones(spark):
    rows = [(["a", "b", "only"], "block")] * 1 + [(["b", "a"], "block")] * 5 + [(["b"], "allow")] * 4 + [([], "allow")]
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, verdict STRING")
    found = {tuple(r.tokens) for r in urls.learned_tokens(labelled, 0.2, 1).collect()}
    assert found == {("b",), ()}
    assert {tuple(r.tokens) for r in urls.learned_tokens(labelled, 0.2).collect()} == {("b", "a"), ("b",), ()}


def test_rules_are_mined_from_long_urls(spark):
    """The token that tells is the rarest of a URL; thirty others always come together."""
    filler = [f"t{i:02}" for i in range(30)]
    rows = []
    for i in range(400):
        mixed = [f"m{k}" for k in range(9) if i % 10 != k]
        rows.append((["all", *filler, *mixed, "tells"] if i < 40 else ["all", *filler, *mixed] if i < 200 else ["all", *mixed], "block" if i < 40 or i % 2 else "allow"))
    labelled = spark.createDataFrame(rows, "tokens ARRAY<STRING>, verdict STRING")
    rules = urls.mine(labelled, 0.05, 0.7)
    found = {(tuple(r.tokens), r.verdict): r for r in rules.collect()}
    assert found[("tells",), "block"].confidence == 1.0 and found[("tells",), "block"].support == 0.1
    assert not any("all" in tokens for tokens, _ in found)
    counted = [(set(t), v) for t, v in rows]
    for (tokens, verdict), rule in found.items():
        having = [v for t, v in counted if t >= set(tokens)]
        assert rule.confidence == pytest.approx(having.count(verdict) / len(having))
        assert rule.support == pytest.approx(having.count(verdict) / len(rows))


def test_tokens_that_come_together_stand_for_each_other(spark):
    rows = [(i, f"http://a.net/x/left/right/{i}") for i in range(20)] + [(100 + i, f"http://b.org/fr/{i}") for i in range(20)]
    rows += [(200, "http://other.com/left"), (201, "http://other.com/right"), (202, "http://other.com/right/left"), (203, "http://other.com/")]
    found = by_id(urls.judge(spark.createDataFrame(rows, "page_id BIGINT, url STRING")), "page_id")
    assert [(found[i][0]["verdict"], found[i][0]["source"]) for i in range(200, 204)] == [("block", "mined")] * 3 + [("allow", "default")]


# --- vectors ------------------------------------------------------------------------

ODD = [(1001, None), (1002, []), (1003, [1.0, None]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]),
       (1006, [0.0] * 16), (1007, [1.0, 2.0]), (1010, [-2.0, 1.0]), (1008, [2.0, 4.0]), (None, [1.0] * 16)]


def vectors(n, seed, d=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 15), d))
    x = centers[rng.integers(0, len(centers), n)] + 0.05 * rng.normal(size=(n, d))
    x[: n // 4] = rng.normal(size=(n // 4, d))
    x[-5:] = x[0]
    return x.astype(np.float32)


def plain_top(ids, x, k, every):
    whole, out = np.floor(64 * x.astype(float)).astype(np.int64), {}
    for q in ids[ids % every == 0]:
        s = whole @ whole[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), int(s[i])) for i in order]
    return out


@pytest.mark.parametrize("n, block", [(12, 8192), (400, 8192), (400, 50)])
def test_top_k_against_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "CHUNK", max(5, block // 8))
    monkeypatch.setattr(covertree, "SAMPLE", 100)
    x, ids = vectors(n, n), np.arange(n)
    table = embeddings(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)] + ODD + [(3, x[3].tolist())])
    found = {}
    for r in covertree.top_k(table, 20, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # the repeated row is a candidate of its own
    expected = plain_top(np.append(ids, 3), np.concatenate([x, x[3:4]]), 20, 5)
    small = {i: np.floor(64 * np.array(v)) for i, v in ODD if i in (1007, 1008, 1010)}
    expected[1010] = sorted(((i, int(v @ small[1010])) for i, v in small.items() if i != 1010), key=lambda p: (-p[1], p[0]))
    zero = [(1006, 0)]
    for q in expected:
        if q < 1000:
            expected[q] = sorted(expected[q] + zero, key=lambda p: (-p[1], p[0]))[:20]
    assert found == expected
    assert covertree.top_k(table.where("false")).count() == 0


def test_top_k_of_rows_that_share_an_id_equals_the_sql(spark):
    import duckdb

    x, pick = vectors(200, 4), np.random.default_rng(2)
    rows = [(int(i), v.tolist()) for i, v in zip(pick.integers(0, 90, 200), x)]
    rows += [(20, [5.0, 0.0]), (20, [0.0, 5.0]), (5, [5.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), rows[7], rows[7]]
    for some in (rows[-7:-2], rows[:200] + rows[-2:]):  # the SQL compares vectors of one length
        connection = duckdb.connect()
        connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        connection.executemany("INSERT INTO embeddings VALUES (?, ?)", some)
        expected = connection.execute(queries.ORACLES["op5_top_k"]).fetchall()
        found = [(r.query_id, r.rank, r.vec_id, r.score) for r in covertree.top_k(embeddings(spark, some)).collect()]
        assert sorted(found) == sorted(expected)


def test_rows_that_share_an_id_count_their_own_links(spark):
    far, near = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(7, far), (8, near), (7, [0.0, 1.0, 0.0]), (9, [0.05, 0.99, 0.0]), (10, [0.0, 0.98, 0.05]), (3, [0.0, 0.0, 1.0]), (8, near)]
    found = crosspolytope.near_duplicates(embeddings(spark, rows))
    # the rows of id 7 are one node, so both groups are one component
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == [
        (3, 0, 3, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 2, 7, False), (10, 2, 7, False)]
    two = [(7, [1.0, 0.0]), (8, [0.999, 0.01]), (7, [0.0, 1.0]), (9, [0.01, 0.999]), (10, [0.02, 0.999])]
    assert sorted((r.vec_id, r.n_links) for r in crosspolytope.near_duplicates(embeddings(spark, two)).collect()) == [
        (7, 1), (7, 2), (8, 1), (9, 2), (10, 2)]


def test_cosine_links_against_brute_force(spark):
    for chunk in (1024, 7):
        x = vectors(300, 8)
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
        found = by_id(crosspolytope.near_duplicates(embeddings(spark, rows), chunk=chunk), "vec_id")
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        links = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95)) if i != j}
        label = plain_components(range(300), links)
        for i in range(300):
            row = found[i][0]
            assert row["n_links"] == sum(a == i for a, _ in links)
            assert row["component_id"] == label[i] and row["kept"] == (label[i] == i)
        assert found[1007][0]["n_links"] == 1 and found[1008][0]["component_id"] == 1007
        for i in (1001, 1002, 1003, 1004, 1005, 1006, None):
            assert found[i][0]["n_links"] == 0 and found[i][0]["component_id"] == i and found[i][0]["kept"]
    assert crosspolytope.near_duplicates(embeddings(spark, [])).count() == 0


def test_recall_at_the_limit():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    first, second = crosspolytope.bucket_codes(a), crosspolytope.bucket_codes(b)
    assert (first[:, :, :, None] == second[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99


def test_codes_do_not_depend_on_the_batch():
    x = vectors(50, 1)
    assert (crosspolytope.bucket_codes(x)[7:9] == crosspolytope.bucket_codes(x[7:9])).all()
