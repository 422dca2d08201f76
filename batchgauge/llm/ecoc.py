"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte trigrams
(log odds of the trigram among languages with and without the bit) reads the text; decoding adds up
a loss per bit, weighted by how often the bit's classifier was right on documents it did not learn
from, and chooses the codeword with the smallest sum. A small lead over the second best flags
the answer as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema, id_and_text, per_slice, slices, texts
from batchgauge.operators.slicing import stored_small
from batchgauge.session import materialise

BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 3000
"""Documents per language to learn from, about; chosen by a hash of ``doc_id``."""
FOLDS = 5
AMBIGUOUS = 0.2
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
"""Letters in lower case; every other ASCII character becomes a space."""
PIECE = 1 << 20


def held_out() -> Column:
    """True for documents that are never learned from: crc32 of the id as text, divisible by five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a whole text, in pieces of bounded size."""
    data = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(_BYTES) + b" ", np.uint8)
    for at in range(0, len(data) - 2, PIECE):
        b = data[at : at + PIECE + 2].astype(np.uint32)
        yield (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A matrix of +1 / -1, one row per language.

    Up to seven languages: all ways to part them in two. Beyond: random words of 10 log2 n bits, of
    several draws the one whose closest words are furthest apart.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        parts = [p for p in itertools.product((1, -1), repeat=languages) if p[0] == 1 and -1 in p]
        return np.array(parts, float).T
    bits, rng = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed)

    def spread(words):
        agree = words @ words.T
        np.fill_diagonal(agree, -bits)
        return -agree.max()

    draws = [rng.choice((-1.0, 1.0), (languages, bits)) for _ in range(20)]
    return max((d for d in draws if (abs(d.sum(0)) < languages).all()), key=spread, default=draws[0])


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Evidence for each bit: the mean log odds, drawn towards zero for very short texts."""
        total, n = np.zeros(self.weights.shape[1]), 20
        for grams in trigrams(text):
            total += self.weights[grams].sum(0, dtype=np.float64)
            n += len(grams)
        return total / n

    def decide(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """The nearest codeword, a share of belief between 0 and 1, and whether the lead is small."""
        loss = (np.exp(np.clip(-4 * margins * self.words, -30, 30)) * self.trust).sum(1)
        belief = np.exp(loss.min() - loss)
        belief /= belief.sum()
        best = int(np.argmin(loss))
        rest = np.delete(belief, best).max(initial=0.0)
        return best, float(belief[best]), bool(belief[best] - rest < AMBIGUOUS)


def _by_language(sample: DataFrame, ddl: str, rows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = rows((lang, t) for b in slices(batches) for lang, t in zip(b.column("lang").to_pylist(), texts(b)))
        schema = arrow_schema(ddl)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return sample.select("lang", "text").mapInArrow(run, ddl)


def train(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from documents that are not held out and have text and ``lang``.

    What reaches the driver is the number of documents and of trigrams per language and bucket. One fold
    weighs the bits and does not teach; a language with no other document in the sample teaches by it.
    """
    labelled = id_and_text(documents, F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    labelled = labelled.where(~held_out())
    sizes = labelled.groupBy("lang").count().withColumn("share", F.lit(per_language) / F.col("count"))
    shares = stored_small(sizes.select("lang", "share"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = labelled.join(shares, "lang").where((draw < F.col("share")) & F.col("text").rlike(r"\p{L}"))
    sample = materialise(sample.select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold")))

    def count(rows):
        counts: dict[str, np.ndarray] = {}
        for lang, text in rows:
            own = counts.setdefault(lang, np.zeros(BUCKETS))
            for grams in trigrams(text):
                own += np.bincount(grams, minlength=BUCKETS)
        nonzero = {lang: np.flatnonzero(c) for lang, c in counts.items()}
        return [
            [lang for lang, at in nonzero.items() for _ in at],
            [b for at in nonzero.values() for b in at.tolist()],
            [n for lang, at in nonzero.items() for n in counts[lang][at].astype(int).tolist()],
        ]

    ddl = "lang STRING, bucket INT, n BIGINT"
    most = sample.groupBy("lang").agg(F.max("fold").alias("most"))
    lone = F.col("lang").isin([r["lang"] for r in most.where("most = 0").collect()])
    learn, check = sample.where((F.col("fold") > 0) | lone), sample.where((F.col("fold") == 0) & ~lone)
    counted = _by_language(learn, ddl, count).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    share = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        share[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    share /= share.sum(1, keepdims=True)
    words = codewords(len(languages))
    with_bit, without = (words > 0).astype(float), (words < 0).astype(float)
    mean = lambda part: share.T @ part / np.maximum(part.sum(0), 1)
    weights = np.zeros((BUCKETS, words.shape[1]))
    if len(languages) > 1:
        weights = np.log(mean(with_bit)) - np.log(mean(without))
    model = Model(languages, words, weights.astype(np.float32), np.ones(words.shape[1]))
    held = sample.sparkSession.sparkContext.broadcast(model)

    def verify(rows):
        right, total = np.zeros(words.shape[1]), 0
        for lang, text in rows:
            if lang in held.value.languages:
                word = held.value.words[held.value.languages.index(lang)]
                right += held.value.margins(text) * word > 0
                total += 1
        return [list(range(len(right))), right.astype(int).tolist(), [total] * len(right)]

    seen = _by_language(check, "bit INT, correct BIGINT, n BIGINT", verify).groupBy("bit").agg(F.sum("correct"), F.sum("n")).collect()
    for bit, correct, n in seen:
        rate = (correct + 1) / (n + 2)  # a bit read wrong half of the time has no say
        model.trust[bit] = max(0.0, 2 * rate - 1)
    if not model.trust.any():
        model.trust[:] = 1
    return model


def _answer(model: Model, text: str) -> tuple[str, float, bool]:
    if not model.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0, True
    best, score, ambiguous = model.decide(model.margins(text))
    return model.languages[best], score, ambiguous


def identify(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` for every row.

    Null text and text without a letter (``\\p{L}``) are ``und`` with score 0, and so is every text when no
    labelled document is there to learn from. Only the text is read for a prediction. Rows come out as
    they came in, repeated ones too; an empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, per_language))

    def rows(batch: pa.RecordBatch) -> list[list]:
        answers = [_answer(model.value, text) for text in texts(batch)]
        return [batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), *map(list, zip(*answers))]

    ddl = "doc_id BIGINT, held_out BOOLEAN, lang_pred STRING, score DOUBLE, ambiguous BOOLEAN"
    return per_slice(id_and_text(documents, held_out().alias("held_out")), ddl, rows)


def determined(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``documents`` whose language is determined, with all their columns.

    Each row is judged by its own text, so rows that share an id do not decide about each other. Where no
    language could be learned, only null texts and texts without a letter go.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, per_language))
    names = documents.columns
    at = names.index("text")

    def kept(text: str | None) -> bool:
        if not model.value.languages:
            return bool(_LETTER.search(text or ""))
        return _answer(model.value, text or "")[0] != UNDETERMINED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([kept(text) for text in batch.column(at).to_pylist()], pa.bool_()))

    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the names hold
    return plain.mapInArrow(run, plain.schema).toDF(*names)
