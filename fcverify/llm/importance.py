"""Importance resampling towards a target text collection.

Features are the runs of up to two consecutive terms of a text, hashed by CRC-32. The counts
of their buckets over all documents and over all target texts give each bucket a gain, the
logarithm of how much likelier the target makes it; a document's weight is its mean gain. With
Gumbel noise, fixed by id and seed, the highest scores are a draw without replacement in
proportion to exp(weight).

Hashing works on the distinct features of a block of texts: features of one length form a
two-dimensional byte array, whose checksums advance together, column by column, and are
scattered back to the features' places.

All counts cover all rows. A task returns at most one row a bucket; the table of gains has as
many entries as there are buckets. Ranks come from a range partitioning of the narrow rows
(id, counts, score) and the sizes of its partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored, texts
from fcverify.llm.words import term_blocks

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 7, 20, 25
# Words that are hashed together; bytes of one matrix; features longer than LONG are hashed one by one.
GROUP, CELLS, LONG = 1 << 17, 1 << 22, 256


def _crc_table() -> np.ndarray:
    """The byte-wise table of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every column of a uint8 matrix: row i holds byte i of all of them."""
    crc = np.full(matrix.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    for row in matrix:
        crc = _TABLE[(crc ^ row) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
    return ~crc


def crc_slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data`` (uint8), by matrices of equal lengths."""
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
        if size > LONG:
            for i in order[a:b]:
                out[i] = zlib.crc32(data[start[i]:start[i] + size])
            continue
        step = max(1, CELLS // max(size, 1))
        for at in range(a, b, step):
            rows = order[at:min(at + step, b)]
            out[rows] = crc_columns(data[start[rows] + np.arange(size)[:, None]])
    return out


class Block:
    """Texts' terms gathered up to about GROUP, then their features' buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.words, self.size, self.row, self.carried = buckets, [], [], [], []

    def add(self, row: int, words: list[bytes], carried: bool) -> bool:
        """``carried``: the first term ended the row's last block and only pairs with the next. True when full."""
        self.words += words
        self.size.append(len(words))
        self.row.append(row)
        self.carried.append(carried)
        return len(self.words) >= GROUP

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every feature."""
        words, size = self.words, np.array(self.size)
        segment = np.repeat(np.arange(len(size)), size)
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        code = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(length + 1) - length - 1

        _, first = np.unique(code, return_index=True)
        single = self._hashed(data, start[first], length[first])[code]
        fresh = np.ones(len(words), dtype=bool)
        fresh[(np.cumsum(size) - size)[self.carried]] = False

        at = np.flatnonzero(segment[1:] == segment[:-1])
        _, first, inverse = np.unique(code[at] * len(numbers) + code[at + 1], return_index=True, return_inverse=True)
        lead = at[first]
        double = self._hashed(data, start[lead], length[lead] + 1 + length[lead + 1])[inverse]
        row = np.array(self.row, dtype=np.int64)[segment]
        return np.r_[row[fresh], row[at]], np.r_[single[fresh], double]

    def _hashed(self, data, start, length) -> np.ndarray:
        return (crc_slices(data, start, length) % np.uint32(self.buckets)).astype(np.int64)


def _blocks(column: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    block = Block(buckets)
    for row, text in enumerate(column):
        tail: list[bytes] = []
        for words in term_blocks(text):
            full = block.add(row, tail + words, bool(tail))
            tail = words[-1:]
            if full:
                yield block.features()
                block = Block(buckets)
    if block.words:
        yield block.features()


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts of ``rows`` (a column ``text``) fall into each bucket."""
    ready(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in _blocks(batch.column(0).to_pylist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = (rows.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # one row a bucket at most
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the target's share of a bucket to the source's."""
    buckets, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    return np.array([np.floor(1000 * log(((t + 1.0) * (big_s + buckets)) / ((s + 1.0) * (big_t + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain, of every row; 0 without features."""
    ready(docs.sparkSession)
    buckets = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for row, bucket in _blocks(batch.column("text").to_pylist(), buckets):
                n += np.bincount(row, minlength=batch.num_rows)
                # sums of whole numbers below 2^53 are exact in doubles
                total += np.bincount(row, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            # n words make 2n - 1 features
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((n + 1) // 2), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a standard Gumbel number g drawn by the id; a null id draws as the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` (with ``doc_id``, ``score``) and their ``rank`` by falling score and rising ``doc_id``, null beyond ``drawn``.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes
    of those before it. The last key deals rows out that are equal in score and id, of which there may be many.
    Null ids come last.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("dealt")]
    place = F.monotonically_increasing_id()
    placed = stored(rows.withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
                    .select(*rows.columns, F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("nth")), "ranked")
    # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("part").agg(F.count("*").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    rank = F.col("before") + F.col("nth") + 1
    return placed.join(parts, "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
             seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    ``target`` is a table with a column ``text``. Of the rows with ``min_words`` terms or more ``percent`` of a hundred,
    rounded down, are drawn: those with the highest scores, of equal ones the smaller id, null last. Repeated rows take part
    each for itself. Null and empty texts have no features and weigh 0. Without target texts every bucket's target count is 0.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = stored(weighed(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    able = rows.filter(F.col("n_words") >= min_words)
    return ranked(able, able.count() * percent // 100).unionByName(
        rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns. Rows that share a drawn id all come."""
    chosen = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["drawn_id"]), "left_semi")
