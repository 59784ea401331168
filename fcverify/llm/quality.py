"""Quality rules: plain counts with fixed limits, then a classifier with a fixed threshold.

The classifier is a logistic regression over hashed word and byte n-grams, trained on a
bounded, hash-drawn sample of labelled rows. A fifth of the sample fits the calibration of
its probability (Platt). Every text is scored whole, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.store import ragged, ready, texts
from fcverify.llm.words import gram_counts, utf8, word_blocks

# Fixed limits: fewest words, largest share of repeated words in percent, least probability of good quality.
MIN_WORDS, MAX_REPEATED, MIN_QUALITY = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
GAPS = " \t\n\v\f\r"
WINDOW = 3
WORD_BUCKETS, GRAM_BUCKETS, SIZES = 1 << 14, 1 << 14, (2, 3, 4)
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def word_numbers(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers in the order of their first use, and the different words."""
    number: dict[bytes, int] = {}
    parts = []
    for words in word_blocks(data):
        for w in words:
            if w not in number:
                number[w] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(number)


def repeated_words(word: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text, the first one included."""
    if len(word) < window:
        return 0
    run = word[: len(word) - window + 1]
    for i in range(1, window):  # number the runs of i + 1 words, so that no product overflows
        _, run = np.unique(run * (word.max() + 1) + word[i:len(word) - window + 1 + i], return_inverse=True)
    twice = np.bincount(run)[run] > 1
    covered = np.zeros(len(word), dtype=bool)
    for i in range(window):
        covered[i:len(word) - window + 1 + i] |= twice
    return int(covered.sum())


def count(text: str | None, data: bytes, word: np.ndarray) -> Counts:
    lines = [x for x in data.split(b"\n") if x.split()]
    return Counts(len(word), len(text or "") - sum(map((text or "").count, GAPS)), sum(map(data.count, (bytes([c]) for c in SYMBOLS))),
                  len(lines) - len(set(lines)), repeated_words(word))


def features(data: bytes, word: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Shares of hashed words and word pairs (first half), and of hashed byte n-grams with their case (second half)."""
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[word] if len(word) else np.zeros(0, np.uint32)
    pair = own[:-1] * np.uint32(0x9E3779B1) ^ own[1:]
    bits = np.uint32(32 - (WORD_BUCKETS.bit_length() - 1))
    hashed = (np.r_[own, pair] * np.uint32(0x85EBCA6B)) >> bits
    a = np.bincount(hashed, minlength=WORD_BUCKETS).astype(np.float64)
    b = gram_counts(data, GRAM_BUCKETS, SIZES, fold=False).astype(np.float64)
    # square roots of shares: both halves have length one
    return np.sqrt(np.r_[a / max(1.0, a.sum()), b / max(1.0, b.sum())])


@dataclass(frozen=True)
class QualityModel:
    """``weight`` over BUCKETS; ``slope`` and ``shift`` turn a score into a probability. No weight: everything is good."""

    weight: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, x: np.ndarray) -> float:
        if self.weight is None:
            return 1.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weight + self.bias) + self.shift, -500, 500))))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``h``, ``quality`` and ``text`` of about ``per_class`` rows of each class. Ids whose labels disagree or are null teach nothing."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("doc_id is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"), F.count("quality").alias("n"), F.count("*").alias("all"))
             .filter("quality = most and n = all and quality in (0, 1)")
             .select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)).alias("h")))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    below = F.lit(0)
    for quality, n in sizes.items():
        below = F.when(F.col("quality") == quality, F.lit(min(1 << 30, int(per_class * (1 << 30) / n) + 1))).otherwise(below)
    # at most 4 * per_class ids go to the tasks that read the texts, so that these are not shuffled
    drawn = known.filter(F.col("h") < below).orderBy("h", "doc_id").limit(4 * per_class)
    return texts(docs).filter("text is not null").join(F.broadcast(drawn), "doc_id").select("h", "quality", "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 12, rate: float = 20.0, decay: float = 1e-6,
        seed: int = 11) -> QualityModel:
    """Train on about ``per_class`` labelled rows of each class; with one class only there is no model."""
    ready(docs.sparkSession)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for text in batch.column("text").to_pylist():
                data = utf8(text)
                own = features(data, *word_numbers(data))
                used = np.flatnonzero(own)
                at.append(used.astype(np.int32))
                x.append(own[used].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("quality"), pa.array(at, pa.list_(pa.int32())),
                                              pa.array(x, pa.list_(pa.float32()))], names=["h", "quality", "at", "x"])

    drawn = (labelled(docs, labels, per_class).mapInArrow(bags, "h long, quality int, at array<int>, x array<float>")
             .orderBy("h", "quality").limit(4 * per_class).toArrow())
    y = drawn.column("quality").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return QualityModel(None)
    rows = list(zip(ragged(drawn.column("at")), ragged(drawn.column("x"))))
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    # weights by class: the threshold means the same however common a class is
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight, bias, rng = np.zeros(BUCKETS), 0.0, np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(np.flatnonzero(~held)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(x @ weight[at] + bias, -500, 500)))
            g = step * share[i] * (p - y[i])
            weight[at] -= g * x + step * decay * weight[at]
            bias -= 0.01 * g
    judged = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(y))
    score = np.array([rows[i][1] @ weight[rows[i][0]] + bias for i in judged])
    return QualityModel(weight, bias, *_platt(score, y[judged], share[judged]))


def _platt(score: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores, with targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = score.std() or 1.0
    x, a, b = score / unit, 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, h = share * (p - goal), share * p * (1 - p) + 1e-9
        m = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * x).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a / unit), float(b)) if a > 0 else (1.0, 0.0)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``quality`` (calibrated probability) and ``kept`` of every row.

    A null or empty text has no words and fails the base rules.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                data = utf8(text)
                word, words = word_numbers(data)
                c = count(text, data, word)
                p = 0.0 if c.failed else model.probability(features(data, word, words))
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.failed, p,
                             not c.failed and p >= MIN_QUALITY))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"])

    return texts(docs).mapInArrow(work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                        "n_repeat_words long, base_failed boolean, quality double, kept boolean")
