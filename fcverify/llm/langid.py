"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (word ends marked by
spaces), a linear softmax reads that mean. Embeddings and softmax are trained together
by stochastic gradient descent on a bounded, hash-drawn sample of labelled rows; a
fifth of the sample fits the temperature and the rejection threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.llm.store import ready, texts
from fcverify.llm.words import gram_counts, utf8

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
DIM = 16
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """``table``: one row of class scores per bucket (embedding times softmax weights)."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether the text is rejected.

        No text or no letter: ``und``, 0, rejected. A model without languages says
        ``und`` to everything and rejects only texts without a letter.
        """
        if text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        if not self.languages:
            return UNDETERMINED, 0.0, False
        counts = gram_counts(utf8(text), BUCKETS, SIZES)
        scores = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(scores - scores.max())
        best = int(scores.argmax())
        p = float(e[best] / e.sum())
        return self.languages[best], p, p < self.threshold


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from. A null id is not held out, and not learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def packed(text: str | None) -> bytes:
    """The buckets of a text's grams and their counts, a fifth as long as plain numbers."""
    counts = gram_counts(utf8(text), BUCKETS, SIZES)
    used = np.flatnonzero(counts)
    return zlib.compress(np.diff(used, prepend=0).astype("<i2").tobytes() + counts[used].astype("<f4").tobytes())


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(bag)
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<i2", n), dtype=np.int32), np.frombuffer(raw, "<f4", n, 2 * n)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = pa.array([packed(x) for x in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), bags], names=["lang", "h", "bag"])


def fit(docs: DataFrame, per_language: int = 500, in_all: int = 100_000, epochs: int = 8, rate: float = 0.4,
        reject: float = 0.001, seed: int = 7) -> LanguageModel:
    """Train on about ``per_language`` texts of every language, on fewer of each if that would make more than ``in_all``.

    Rows are drawn by a hash of id and text; the total is bounded by twice ``in_all`` or by two rows
    a language, and no text gives more than one number per bucket. Languages are the values of ``lang``: tags,
    thousands at most. ``reject`` is the share of the texts it was calibrated on that the threshold may cost. A fifth
    of the sample is kept for calibration; with under 50 rows the rows that were learned from are used for it.
    """
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                    & ~held_out(F.col("doc_id"))))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    names = tuple(sorted(r["lang"] for r in counts))
    per_language = max(1, min(per_language, in_all // len(names)))
    below = F.create_map(*[F.lit(x) for r in counts
                           for x in (r["lang"], min(1 << 30, int(per_language * (1 << 30) / r["count"]) + 1))])
    drawn = (rows.withColumn("h", h).filter(F.col("h") < below[F.col("lang")]).select("lang", "h", "text")
             .mapInArrow(_bags, "lang string, h long, bag binary")
             .orderBy("h", "lang").limit(2 * per_language * len(names)).toArrow())
    bags = [unpacked(x) for x in drawn.column("bag").to_pylist()]
    where = [at for at, _ in bags]
    share = [x / x.sum() if x.size else x for _, x in bags]
    label = np.array([names.index(x) for x in drawn.column("lang").to_pylist()], dtype=int)
    if not len(label):
        return LanguageModel(names[:1], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    held = np.arange(len(label)) % 5 == 4 if len(label) >= 50 else np.zeros(len(label), bool)
    model = _descend(where, share, label, np.flatnonzero(~held), len(names), epochs, rate, seed)
    judged = np.flatnonzero(held) if held.any() else np.arange(len(label))
    return _calibrated(names, model, where, share, label, judged, reject)


def _descend(where, share, label, rows, classes, epochs, rate, seed):
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, classes)), np.zeros(classes)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(rows):
            at, w = where[i], share[i]
            if not at.size:
                continue
            mean = w @ embed[at]
            score = mean @ weight + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label[i]] -= 1
            # the step on the embeddings moves the mean of a long text as far as that of a short one
            embed[at] -= step / (w @ w) * np.outer(w, weight @ p)
            weight -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
    return embed @ weight, bias


def _calibrated(names, model, where, share, label, judged, reject) -> LanguageModel:
    table, bias = model
    scores = np.array([share[i] @ table[where[i]] + bias if where[i].size else bias for i in judged])

    def probabilities(t):
        e = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    true = label[judged]
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(probabilities(t)[np.arange(len(true)), true] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = probabilities(t)
    right = p.max(axis=1)[p.argmax(axis=1) == true]
    # half the low quantile: texts unlike any learned language fall below, odd ones stay
    threshold = 0.5 * float(np.quantile(right, reject)) if right.size else 0.0
    return LanguageModel(names, table, bias, t, min(0.5, threshold))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``text``, ``lang_pred``, ``score``, ``rejected`` of every row, from its whole text alone."""
    ready(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return texts(docs).mapInArrow(label, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(x)[2] for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
