"""Near-duplicates by the exact overlap of word shingles: a prefix join.

A text is the set of its hashed five-word shingles. Two texts are near if their sets' Jaccard
similarity is 0.8 or more. All sets are sorted in one order, shingles that many documents
have last. Of n shingles a near text has at least ceil(0.8 n), so the first COMMON shingles
that both have lie within the first n - ceil(0.8 n) + COMMON of either. Those are the keys;
every pair that shares enough of them is a candidate, no near pair is missed, and each
candidate is verified on the whole sets.

A first pass verifies neighbours in every run of equal keys only, and a second one the pairs
that the first has not connected yet, so a large group of near copies is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.golay import SEED
from fcverify.llm.graph import components
from fcverify.llm.store import SLICE as _SLICE
from fcverify.llm.store import bit_slices, freed, ragged, ready, stored, texts, whole_filter
from fcverify.llm.words import utf8, word_blocks

SHINGLE = 5
# The least Jaccard similarity of near texts, as a fraction.
NEAR = (4, 5)
# Shared keys that make a candidate; one is enough for the law, more leave fewer candidates.
COMMON = 3
# Texts from which the order is learned, those of them that make a shingle common, and how many common ones are told apart.
SAMPLE, OFTEN, LISTED = 5_000, 3, 1 << 16
# Bits of the filter that says which texts are in a candidate: so many a text, 16 MB at most, whatever the input.
BITS_A_TEXT, FILTER_BITS = 64, 1 << 27
# Different texts that a task remembers.
HELD = 30_000


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the lower-cased (A-Z) text's word shingles; fewer words than a shingle make one."""
    parts, tail = [], []
    for words in word_blocks(utf8(text).lower()):
        words = tail + words
        tail = words[-(SHINGLE - 1):]
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(words) - SHINGLE + 1)
            parts.append(np.unique(h))
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)] if tail else [], dtype="<u8")
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def digest(shingles: np.ndarray) -> int:
    """A hash of the set; 0 without shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0


def code(text: str | None) -> int:
    """The digest of a text's shingles."""
    return digest(shingle_set(text))


def least(n):
    """How many of its ``n`` shingles a text has in common with any near one, at least."""
    return -(-NEAR[0] * n // NEAR[1])


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of a set: its first shingles, with those in ``common`` (sorted) behind all others."""
    n = len(shingles)
    if len(common):
        found = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~found], shingles[found]])
    return shingles[:n - least(n) + COMMON]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are near."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * sum(NEAR) >= NEAR[0] * (len(a) + len(b))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _codes(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(code(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(work, "doc_id long, fp long")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that several texts of a hash-drawn sample have. They settle an order only, no result."""
    rate = min(1.0, SAMPLE / max(docs.count(), 1))
    drawn = texts(docs).filter(F.pmod(F.xxhash64("text", F.lit("order")), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<u8"), *sets]).view(np.int64))], names=["key"])

    often = (drawn.mapInArrow(work, "key long").groupBy("key").count().filter(F.col("count") >= OFTEN)
             .orderBy(F.desc("count"), "key").limit(LISTED).toArrow())
    return np.sort(often.column("key").to_numpy().view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, fp): the rows whose key another ``fp`` has too, once, and the row before if its size allows a near text."""
    held, met, before = [np.zeros(0, np.int64)] * 3, False, 0

    def rows(key, n, fp, prev, mask):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(fp), pa.array(prev, mask=mask)], names=["key", "n", "fp", "prev"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, fp = (np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, batch.columns))
        new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        key, n, fp = key[new], n[new], fp[new]
        same = np.r_[met, key[1:] == key[:-1]]
        fits = np.r_[before != 0, n[:-1] >= least(n[1:])] & same
        prev = np.r_[before, fp[:-1]]
        out = (same | np.r_[same[1:], False])[:-1]
        if out.any():
            yield rows(*(x[:-1][out] for x in (key, n, fp, prev, ~fits)))
        held, met, before = [key[-1:], n[-1:], fp[-1:]], bool(same[-1]), int(prev[-1]) if fits[-1] else 0
    if met:
        yield rows(*held, np.array([before]), np.array([before == 0]))


def shared_keys(docs: DataFrame) -> DataFrame:
    """``key``, ``n``, ``fp``, ``prev``: the keys that different sets share, with the sets' sizes."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) > HELD:
                seen = set()
            keys, sizes, fps = [np.zeros(0, "<u8")], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                fp = digest(shingles)
                if len(shingles) and fp not in seen:
                    seen.add(fp)
                    keys.append(prefix(shingles, common.value))
                    sizes.append(len(shingles))
                    fps.append(_signed(fp))
            times = [len(k) for k in keys[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int64), times)),
                                              pa.array(np.repeat(np.array(fps, np.int64), times))], names=["key", "n", "fp"])

    out = stored(texts(docs).mapInArrow(work, "key long, n long, fp long").repartition("key").sortWithinPartitions("key", "n", "fp")
                 .mapInArrow(_shared, "key long, n long, fp long, prev long"), "shared")
    common.destroy()
    return out


def filter_bits(n: int) -> int:
    """The size of the filter for ``n`` texts, a power of two. More set bits only let more texts through."""
    return 1 << min(FILTER_BITS.bit_length() - 1, max(_SLICE.bit_length() - 1, (BITS_A_TEXT * n).bit_length()))


def _marked(codes: DataFrame, size: int) -> dict[int, bytes]:
    """One bit of ``size`` for each ``fp``."""
    return bit_slices(codes.select(F.pmod("fp", F.lit(size)).alias("bit")).distinct())


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The near ones of ``pairs`` (u, v: fp), stored, by their whole sets, which are made again of the texts that occur in a pair."""
    codes = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    size = filter_bits(2 * pairs.count())
    chosen = docs.sparkSession.sparkContext.broadcast(_marked(codes, size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(whole_filter(chosen.value, size), dtype=np.uint8), set()
        for batch in batches:
            if len(seen) > HELD:
                seen = set()
            found = {}
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                fp = _signed(digest(shingles))
                bit = fp % size
                if fp not in seen and bits[bit >> 3] >> (7 - (bit & 7)) & 1:
                    seen.add(fp)
                    found[fp] = shingles.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))],
                                             names=["fp", "shingles"])

    made = stored(texts(docs).mapInArrow(work, "fp long, shingles array<long>"), "sets")
    sets = made.groupBy("fp").agg(F.first("shingles").alias("shingles"))
    chosen.destroy()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (ragged(pa.chunked_array([batch.column(c)])) for c in ("a", "b"))
            yield batch.filter(pa.array([near(x, y) for x, y in zip(a, b)], pa.bool_())).select(["u", "v"])

    left, right = sets.toDF("u", "a"), sets.toDF("v", "b")
    links = stored(pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "links")
    freed(made)
    return links


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v, n: the smaller size) by how many keys they share."""
    need = F.least(F.lit(COMMON), F.ceil(F.col("n") * NEAR[0] / NEAR[1]))
    return pairs.groupBy("u", "v", "n").agg(F.count("*").alias("keys")).filter(F.col("keys") >= need).select("u", "v")


def near_links(docs: DataFrame) -> DataFrame:
    """``u``, ``v`` (fp): links that connect all near sets, directly or by others."""
    shared = shared_keys(docs)
    chained = shared.filter("prev is not null").select(F.greatest("fp", "prev").alias("u"), F.least("fp", "prev").alias("v"), F.lit(1 << 30).cast("long").alias("n"))
    chained = stored(_enough(chained), "chained")
    first = verified(docs, chained)
    root = components(first).withColumnsRenamed({"node": "fp"})
    rooted = shared.select("key", "n", "fp").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted.select("key", "n", "fp", "root"), "rooted")
    # the largest component of a key meets the others, never itself
    largest = (rooted.groupBy("key", "root").count().groupBy("key")
               .agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1").drop("roots"))
    among = rooted.join(largest, "key")
    a = among.filter("root <> most").select("key", F.col("n").alias("na"), F.col("fp").alias("fa"), F.col("root").alias("ra"))
    b = among.select("key", F.col("n").alias("nb"), F.col("fp").alias("fb"), F.col("root").alias("rb"), (F.col("root") == F.col("most")).alias("main"))
    fits = F.least("na", "nb") * NEAR[1] >= F.greatest("na", "nb") * NEAR[0]
    crossed = (a.join(b, "key").filter((F.col("ra") != F.col("rb")) & (F.col("main") | (F.col("fa") < F.col("fb"))) & fits)
               .select(F.greatest("fa", "fb").alias("u"), F.least("fa", "fb").alias("v"), F.least("na", "nb").alias("n")))
    crossed = stored(_enough(crossed), "crossed")
    second = verified(docs, crossed)
    freed(shared, chained, rooted, crossed)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``root`` and ``component_id``, the smallest ``doc_id`` that links of near texts lead to.

    Copies are folded by ``fp``, the digest of their shingles, first; ``root`` is the
    component's smallest one. Texts without words are copies of each other. A row without
    id belongs to its component but gives it no name.
    """
    ready(docs.sparkSession)
    rows = stored(_codes(docs), "codes")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(docs)).withColumnsRenamed({"node": "fp"})
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return (rows.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")
            .select("doc_id", "fp", "root", "component_id"))
