"""SimHash near-duplicates through the binary Golay code [23, 12, 7].

Every 23-bit word lies within three bits of exactly one codeword. The codewords of a
word and of its one-bit neighbours are few (one or six for 23 bits), and two words that
differ in at most two bits share one of them: the codeword of the word between them.

A 64-bit fingerprint is cut into four segments of 16 bits. If two fingerprints differ
in at most three bits, then without the worst segment they differ in at most two, so
for one of the four triples of segments they share a triple of codewords in which at
most one segment took a neighbour. Those triples are the keys. Equal keys are joined
and every candidate is verified by its Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fcverify.llm.graph import components
from fcverify.llm.store import ready, stored, texts
from fcverify.llm.words import utf8, word_blocks

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENT = 16
# Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0xC75
# Members of a key that one task compares with each other at once.
BLOCK = 1024


def fingerprint(text: str | None) -> int:
    """SimHash of the lower-cased (A-Z) text over its word shingles, repeats included; 0 without words.

    A bit is one if it is set in over half of the shingles' hashes. Fewer words than a
    shingle make one shingle.
    """
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(utf8(text).lower()):
        words = tail + words
        tail = words[-(SHINGLE - 1):]
        if len(words) < SHINGLE:
            continue
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(words) - SHINGLE + 1)
        total += len(h)
        for at in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(work, "doc_id long, fp long")


@lru_cache(maxsize=1)
def codebook() -> tuple[np.ndarray, np.ndarray]:
    """For every segment value its codeword's index, and the other indices its one-bit neighbours decode to (-1: none)."""
    def syndrome(words: np.ndarray) -> np.ndarray:
        left = words.copy()
        for bit in range(22, 10, -1):
            left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
        return left

    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    nearest = np.zeros(1 << 11, dtype=np.int64)
    nearest[syndrome(errors)] = errors
    words = np.arange(1 << SEGMENT)
    index = (words ^ nearest[syndrome(words)]) >> 11
    near = np.sort(np.stack([index[words ^ (1 << b)] for b in range(SEGMENT)], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == index[:, None]] = -1
    near = -np.sort(-near, axis=1)
    return index, near[:, :int((near >= 0).sum(axis=1).max())]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (unsigned), and for each key the position of its fingerprint. No key comes twice for one."""
    index, near = codebook()
    parts = [(fp >> np.uint64(SEGMENT * i) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for i in range(4)]
    own, other = [index[p] for p in parts], [near[p] for p in parts]
    keys, at = [], []
    for number, triple in enumerate(combinations(range(4), 3)):
        base = np.full(len(fp), number, dtype=np.int64)
        for s in triple:
            base = base << 12 | own[s]
        keys.append(base)
        at.append(np.arange(len(fp)))
        for place, s in enumerate(triple):
            shift = 12 * (2 - place)
            row, col = np.nonzero(other[s] >= 0)
            keys.append(base[row] & ~(0xFFF << shift) | other[s][row, col] << shift)
            at.append(row)
    return np.concatenate(keys), np.concatenate(at)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` nodes the smallest node each is connected with through the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def link_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in runs of equal keys: links that connect all rows of a run within the bound, at most one a row."""
    u, a, b, d = fp.view(np.uint64), [], [], 1
    at = np.flatnonzero(key[1:] == key[:-1])
    while at.size:
        hit = at[np.bitwise_count(u[at] ^ u[at + d]) <= MAX_BITS]
        a.append(hit)
        b.append(hit + d)
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
    if not a or not sum(map(len, a)):
        return fp[:0], fp[:0]
    root = _forest(np.concatenate(a), np.concatenate(b), len(key))
    moved = np.flatnonzero(root != np.arange(len(key)))
    return fp[moved], fp[root[moved]]


_FOUND = "kind int, key long, block long, a long, b long"


def _found(kind, key, block, a, b) -> pa.RecordBatch:
    n = len(a)
    full = lambda x: np.full(n, x, dtype=np.int64) if np.isscalar(x) else x
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), pa.array(full(key)), pa.array(full(block)),
                                       pa.array(a), pa.array(full(b))], names=["kind", "key", "block", "a", "b"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp): links of the runs up to BLOCK rows (kind 0); longer runs pass through in blocks (kind 1)."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot, seen = None, 0

    def flush(key, fp):
        nonlocal hot, seen
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        large = (size > BLOCK) | (key[start] == hot)
        of = np.repeat(large, size)
        a, b = link_runs(key[~of], fp[~of])
        if len(a):
            yield _found(0, 0, 0, a, b)
        for s, n in zip(start[large], size[large]):
            seen = seen if key[s] == hot else 0
            hot = key[s]
            yield _found(1, key[s:s + n], (seen + np.arange(n)) // BLOCK, fp[s:s + n], 0)
            seen += n

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False)]
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if len(key) - cut > BLOCK or key[-1] == hot:
            cut = len(key)
        if cut:
            yield from flush(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield from flush(key, fp)


def near_links(fps: DataFrame) -> DataFrame:
    """``u``, ``v`` (long): links that connect all distinct ``fp`` which differ in at most three bits, directly or by others.

    A key with more than BLOCK members is dealt out as pairs of blocks: memory stays
    bounded and every pair of members meets exactly once. Per key and block pair at most one
    link a member leaves the task, never all pairs.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            key, at = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"])

    found = stored(fps.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
                   .mapInArrow(_scan_runs, _FOUND), "golay")
    hot = found.filter("kind = 1").select("key", "block", F.col("a").alias("fp"))
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = (hot.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
             .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp"))

    def compare(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        a, b = link_runs(np.zeros(len(fp), np.int64), fp)
        return pa.table({"u": a, "v": b})

    return (found.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
            .unionByName(pairs.groupBy("key", "low", "high").applyInArrow(compare, "u long, v long")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``root`` and ``component_id``, the smallest ``doc_id`` that links of near fingerprints lead to.

    Copies are folded by fingerprint first; ``root`` is the component's smallest
    fingerprint. A null text has fingerprint zero, as an empty one. A row without id
    belongs to its component but gives it no name.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(fps)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return (rows.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")
            .select("doc_id", "fp", "root", "component_id"))


def keep_first(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates,
               code: Callable[[str | None], int] = fingerprint) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest ``doc_id``, with all columns of ``docs``.

    ``groups`` finds the groups and ``code`` gives a text's ``fp`` in them. Of several rows with that id the one with the smallest text stays. A group without
    any id keeps the row with the smallest text.
    """
    ready(docs.sparkSession)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    found = groups(docs)
    flat = docs.select(*[F.col(c).alias(a) for a, c in zip(columns, docs.columns)],
                       F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("row_text"))
    at = len(columns) + 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([code(x) for x in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, "fp"])

    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = flat.join(kept, flat["row_id"] == kept["doc_id"], "left_semi").withColumn("grp", F.col("row_id"))
    lone = found.filter("component_id is null").groupBy("fp").agg(F.min("root").alias("grp"))
    nameless = (flat.filter("row_id is null")
                .mapInArrow(coded, T.StructType([*flat.schema.fields, T.StructField("fp", T.LongType())])).join(lone, "fp"))
    smallest = F.row_number().over(Window.partitionBy("grp").orderBy("row_text"))

    def one(rows: DataFrame) -> DataFrame:
        return rows.withColumn("nth", smallest).filter("nth = 1").select(
            *[F.col(a).alias(c) for a, c in zip(columns, docs.columns)])

    return one(named).unionByName(one(nameless.select(*named.columns)))
