"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field adds spans the patterns miss: it labels the tokens that hold
a digit or ``@`` and the words around them. Its potentials join a token's features with its
label, the labels of neighbours, and, as skip edges, the labels of distant tokens of one document
that repeat each other or agree in their digits or mail name. Loopy belief propagation passes
messages over both kinds of edges, so one clear occurrence decides the unclear ones.

Potentials are learned piece by piece (a softmax over features, log odds of label pairs for
neighbours and for skip edges) on a bounded sample of documents, with the base spans as labels.
Tokens in a base span are observed. Three and more tokens that agree meet in a hub, a variable of
their own that takes the labels observed on them, so every one of them is two edges from a clear
one, however long the document.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, per_slice, slices, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS = 40_000
"""Documents to learn from, about; chosen by a hash of ``doc_id``."""
NODES_LEARNED = 400
"""Nodes of one document that are learned from; inference reads all. Of a document with more, runs of
``RUN`` nodes are drawn by hash from all over it."""
RUN = 20
FEATURES = 1 << 15
CONFIDENT = 0.9
ROUNDS = 25
"""Rounds after which messages that still change are taken over in smaller steps."""
TOLERANCE = 1e-3
OBSERVED = 1e9
"""Log odds of an observed label, beyond what all messages of a document can add up to."""

# The base patterns.
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, digit sums added."""
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the whole pattern, found from each ``@`` to the left, which takes linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and _EMAIL_LEFT.match(text, left - 1):
            left -= 1
        right = _EMAIL_RIGHT.match(text, at) if left < at else None
        if right:
            yield left, right.end()
            done = right.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind in its listed order."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if _MARK.search(text):
        for m in _IP.finditer(text):
            # without leading zeros three digits are enough, so huge runs of digits are never converted
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


# --- the graph of a document --------------------------------------------------------


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    marked: np.ndarray
    """Whether a node holds a digit or ``@``; the other nodes are its neighbours."""
    chain: np.ndarray
    skip: np.ndarray
    """Two nodes that agree, or a node and a hub; hubs are numbered behind the nodes."""
    pairs: np.ndarray
    """Nodes that agree with the one before, which the potentials of skip edges are learned from."""
    features: list[list[int]]


def _shape(token: str) -> str:
    kinds = ("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    runs, last = [], ""
    for kind in kinds:
        if kind != last:
            runs.append(kind)
        last = kind
    return "".join(runs)


def _features(text: str, spans: list[tuple[int, int]], i: int) -> list[int]:
    token = text[slice(*spans[i])]
    digits = len(_digits(token))
    named = [
        f"s{_shape(token)}", f"d{min(digits, 20)}", f"d{min(digits, 20)}s{_shape(token)}", f"l{min(len(token), 24) // 2}",
        f"@{'@' in token}", f".{min(token.count('.'), 5)}", f"+{token[:1]}", f"${token[-1:] if not token[-1:].isalnum() else 'a'}",
    ]
    for step in (-1, 1):
        beside = text[slice(*spans[i + step])] if 0 <= i + step < len(spans) else ""
        named.append(f"n{step}{_shape(beside)}")
    return [zlib.crc32(n.encode("utf-8", "replace")) % FEATURES for n in named]


def _alike(token: str) -> list[str]:
    """What a token shares with others that mean the same."""
    plain = token.strip(".,;:!?()[]<>\"'").lower()
    keys = [f"t{plain}"] if plain else []
    digits = _digits(plain)
    if len(digits) >= 6:
        keys.append(f"d{digits}")
    if "@" in plain:
        keys.append(f"m{plain.split('@')[0]}")
    elif any(c in "._" for c in plain) and not digits == plain:
        keys.append(f"m{plain}")
    return keys


def graph(text: str) -> Graph | None:
    """Nodes and edges of a document; None where no token holds a digit or ``@``."""
    spans: list[tuple[int, int]] = []
    marked: list[bool] = []
    links: list[tuple[int, int]] = []
    mark = _MARK.search(text)
    if not mark:
        return None
    while mark:
        at = mark.start()
        left = at
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        token = _TOKEN.match(text, left)
        before = left
        while before > 0 and text[before - 1].isspace():
            before -= 1
        if spans and spans[-1][1] == before:  # the token before is a node already
            links.append((len(spans) - 1, len(spans)))
        elif before > 0:
            start = before
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            spans.append((start, before))
            marked.append(False)
            links.append((len(spans) - 1, len(spans)))
        spans.append(token.span())
        marked.append(True)
        after = _TOKEN.search(text, token.end())
        mark = _MARK.search(text, token.end())
        if after and not (mark and after.start() <= mark.start() < after.end()):
            spans.append(after.span())
            marked.append(False)
            links.append((len(spans) - 2, len(spans) - 1))
    seen: dict[str, list[int]] = {}
    pairs, joined = set(), set()
    for i, (a, b) in enumerate(spans):
        if marked[i]:
            keys = _alike(text[a:b])
            for key in keys:
                group = seen.setdefault(key, [])
                if group and group[-1] != i:
                    pairs.add((group[-1], i))
                group.append(i)
            joined.update(keys[1:] or keys)  # tokens of one first key share the others too
    groups = sorted({tuple(sorted(set(seen[key]))) for key in joined if len(set(seen[key])) > 1})
    skips, hubs = set(), 0
    for group in groups:
        if len(group) == 2:
            skips.add(group)
        else:  # two edges apart through their hub, so long documents stay sparse
            skips.update((i, len(spans) + hubs) for i in group)
            hubs += 1
    return Graph(
        spans, np.array(marked), np.array(links, np.int64).reshape(-1, 2),
        np.array(sorted(skips), np.int64).reshape(-1, 2), np.array(sorted(pairs), np.int64).reshape(-1, 2),
        [_features(text, spans, i) for i in range(len(spans))],
    )


def labels_of(found: Graph, spans: list[tuple[int, int, str]]) -> list[int]:
    """Per node 0, or 1 + the kind of the base span that covers most of it."""
    out, j = [], 0
    for a, b in found.spans:
        while j < len(spans) and spans[j][1] <= a:
            j += 1
        size, label = 0, 0
        at = j
        while at < len(spans) and spans[at][0] < b:
            s, e, kind = spans[at]
            if e > a:
                size, label = max((size, label), (min(b, e) - max(a, s), 1 + KINDS.index(kind)))
            at += 1
        out.append(label if 2 * size > b - a else 0)
    return out


# --- potentials and inference -------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, found: Graph, observed: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every node, then every hub, by loopy, damped sum-product in the log domain.

        ``observed`` has a label above 0 where a node's is known; a hub's label is one of those
        observed on its nodes. Messages go round until they have settled.
        """
        node = np.array([self.weights[f].sum(0) for f in found.features])
        n = len(node)
        hubs = max(0, found.skip.max(initial=-1) + 1 - n)
        node = np.concatenate([node, np.zeros((hubs, node.shape[1]))])
        if observed is not None:
            known = np.flatnonzero(observed)
            node[known] = -OBSERVED
            node[known, observed[known]] = 0.0
            seen = np.zeros((hubs, node.shape[1]))
            to_hub = found.skip[found.skip[:, 1] >= n]
            to_hub = to_hub[observed[to_hub[:, 0]] > 0]
            np.add.at(seen, (to_hub[:, 1] - n, observed[to_hub[:, 0]]), 1)
            told = seen.any(1)
            share = seen[told] / seen[told].sum(1, keepdims=True)
            node[n:][told] = np.where(share > 0, np.log(np.maximum(share, 1e-9)), -OBSERVED)
        edges = np.concatenate([found.chain, found.skip])
        tables = np.concatenate([
            np.broadcast_to(self.chain, (len(found.chain), *self.chain.shape)),
            np.broadcast_to(self.skip, (len(found.skip), *self.skip.shape)),
        ])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        reverse = np.roll(np.arange(len(source)), len(edges))
        messages = np.zeros((len(source), node.shape[1]))
        step, rounds = 0.5, 0
        while step > TOLERANCE:
            belief = node.copy()
            np.add.at(belief, target, messages)
            out = _logsumexp((belief[source] - messages[reverse])[:, :, None] + tables, 1)
            out -= out.max(1, keepdims=True)
            change = abs(out - messages).max(initial=0)
            messages = (1 - step) * messages + step * out
            if change < TOLERANCE:
                break
            rounds += 1
            if rounds % ROUNDS == 0 and rounds > 4 * ROUNDS:  # messages that swing come to rest in smaller steps
                step /= 2
        belief = node.copy()
        np.add.at(belief, target, messages)
        return np.exp(belief - _logsumexp(belief, 1)[:, None])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def learn_field(examples: list[tuple[list[list[int]], list[int], list, list]], passes: int = 60) -> Field:
    """Piecewise training from (features, labels, chain edges, skip edges) of documents."""
    n = len(KINDS) + 1
    rows = [f for features, _, _, _ in examples for f in features]
    labels = np.array([y for _, ys, _, _ in examples for y in ys], np.int64)
    weights = np.zeros((FEATURES, n))
    if rows:
        x, truth, squares = np.array(rows), np.eye(n)[labels], np.full((FEATURES, n), 1e-8)
        for _ in range(passes):  # AdaGrad on the softmax likelihood with a small ridge
            score = weights[x].sum(1)
            slope = np.exp(score - _logsumexp(score, 1)[:, None]) - truth
            step = np.zeros_like(weights)
            for column in x.T:
                np.add.at(step, column, slope)
            step += 0.01 * weights
            squares += step * step
            weights -= 0.3 * step / np.sqrt(squares)

    def pairs(which: int) -> np.ndarray:
        counts = np.full((n, n), 0.5)
        for _, ys, *edges in examples:
            for a, b in edges[which]:
                counts[ys[a], ys[b]] += 1
                counts[ys[b], ys[a]] += which  # skip edges have no direction
        share = counts / counts.sum()
        return np.clip(np.log(share) - np.log(share.sum(1, keepdims=True)) - np.log(share.sum(0, keepdims=True)), -3, 3)

    return Field(weights, pairs(0), pairs(1))


def drawn(found: Graph, most: int = NODES_LEARNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of a document to learn from, and the chain edges and pairs among them by place in it."""
    n = len(found.spans)
    kept = np.ones(n, bool)
    if n > most:
        runs = sorted(range(-(-n // RUN)), key=lambda r: zlib.crc32(b"%d of %d" % (r, n)))
        kept = np.isin(np.arange(n) // RUN, runs[: most // RUN])
    place = np.cumsum(kept) - 1
    inside = (place[edges[kept[edges].all(1)]] for edges in (found.chain, found.pairs))
    return np.flatnonzero(kept), *inside


def train(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Field:
    """Learn from about ``sample`` documents; only feature numbers of marked tokens reach the driver."""
    rows = id_and_text(documents)
    share = sample / max(1, rows.count())
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_003)) / 1_000_003 < share)
    ddl = "features ARRAY<INT>, labels ARRAY<INT>, chain ARRAY<INT>, skip ARRAY<INT>"

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in texts(batch):
                found = graph(text)
                if found is None:
                    continue
                labels = labels_of(found, base_spans(text))
                nodes, chain, pairs = drawn(found)
                out[0].append([i for at in nodes.tolist() for i in found.features[at]])
                out[1].append([labels[at] for at in nodes.tolist()])
                out[2].append(chain.ravel().tolist())
                out[3].append(pairs.ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    learned = []
    for row in chosen.mapInArrow(examples, ddl).toLocalIterator():
        width = len(row["features"]) // len(row["labels"])
        features = np.array(row["features"]).reshape(-1, width).tolist()
        edges = (np.array(row[c], np.int64).reshape(-1, 2).tolist() for c in ("chain", "skip"))
        learned.append((features, row["labels"], *edges))
    return learn_field(learned)


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """Spans of tokens the field labels, clear of all base spans.

    A token counts if its label is confident and skip edges join it, by tokens and hubs of the same
    label, with one in a base span: a repeated or similar form of personal data that is sure.
    """
    found = graph(text) if base else None
    if found is None or not len(found.skip):
        return []
    sure = np.array(labels_of(found, base))
    belief = field.marginals(found, sure)
    best = belief.argmax(1)
    backed = np.zeros(len(best), bool)
    backed[: len(sure)] = sure > 0
    a, b = found.skip[:, 0], found.skip[:, 1]
    same = best[a] == best[b]
    while True:  # along chains of repetitions
        grown = backed.copy()
        np.logical_or.at(grown, a, backed[b] & same)
        np.logical_or.at(grown, b, backed[a] & same)
        if np.array_equal(grown, backed):
            break
        backed = grown
    backed = backed[: len(sure)]
    out = []
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    for i in np.flatnonzero(backed & found.marked & (best[: len(sure)] > 0) & (sure == 0)).tolist():
        start, end = found.spans[i]
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        before = bisect_left(starts, end)  # base spans that begin before this one ends
        clear = not before or furthest[before - 1] <= start
        if start < end and clear and belief[i, best[i]] >= CONFIDENT:
            out.append((start, end, KINDS[best[i] - 1]))
    return out


def all_spans(base: list, added: list) -> list[tuple[int, int, str]]:
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Counts per kind, a digest of the base spans, all spans and the number of added ones.

    Null text counts as empty: no spans. A table without personal data trains a field that adds none. Rows
    come out as they came in, repeated ones too; an empty table gives no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(train(documents, sample))

    def rows(batch: pa.RecordBatch) -> list[list]:
        out: list[list] = [batch.column("doc_id").to_pylist(), *([] for _ in range(7))]
        for text in texts(batch):
            base = base_spans(text)
            added = added_spans(text, base, held.value)
            for column, kind in zip(out[1:5], KINDS):
                column.append(sum(k == kind for _, _, k in base))
            out[5].append(hashlib.sha256(written(base).encode()).hexdigest())
            out[6].append(written(all_spans(base, added)))
            out[7].append(len(added))
        return out

    ddl = (
        "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, "
        "base_sha256 STRING, spans STRING, n_added BIGINT"
    )
    return per_slice(id_and_text(documents), ddl, rows)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``documents`` with personal data replaced in ``text`` and ``n_chars`` set anew; all columns kept.

    Null texts stay null, with the ``n_chars`` they had.
    """
    held = documents.sparkSession.sparkContext.broadcast(train(documents, sample))
    names = documents.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            changed = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    text = redact(text, all_spans(base, added_spans(text, base, held.value)))
                changed.append(text)
            columns = batch.columns
            columns[at] = pa.array(changed, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the names hold
    clean = plain.mapInArrow(run, plain.schema)
    if counted is not None:
        n, text = F.col(f"c{counted}"), F.col(f"c{at}")
        kind = documents.schema[counted].dataType
        clean = clean.withColumn(f"c{counted}", F.when(text.isNull(), n).otherwise(F.length(text).cast(kind)))
    return clean.toDF(*names)
