"""Lexical retrieval packing: windows filled with a document's nearest unused neighbours.

Every document's ids (and an end id) give full windows of their own; what is left over, its
rest, is packed. Rests are range-partitioned by two minima of hashed ids, so that rests with
common ids lie close together, and every run of SHARD of them becomes a shard with an inverted
index of its own. Its impacts are BM25 weights whose document frequencies and mean length are
those of all rests. The longest rest left is the seed: the index returns its best
unused neighbours, which fill the seed's window in the order of their scores. If none of them fits
whole, the best one is cut, and its tail stays for a later window.

So every window is full but the last one of a shard, whose pieces go on to the next shard of the
task. The last one of a task is cut into sequences whose lengths are powers of two: they need no
padding. No row is ever in more than one shard, and a task holds one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored, texts
from fcverify.llm.tokens import encoder

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 0
# Rests of a shard, terms of a seed that are asked for, neighbours returned at once.
SHARD, TERMS, RETURNED = 1024, 12, 24
# The usual parameters of BM25.
K1, B = 1.2, 0.75
# Kinds of rows: a full window, a rest, a term's document frequency.
FULL, REST, TERM = 0, 1, 2

_CUT = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, near long, far long, ids binary"
_CUT_TYPES = (pa.int32(), *[pa.int64()] * 8, pa.binary())
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECE_TYPES = (*[pa.int64()] * 7, pa.binary())


def _batch(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in schema.split(", ")])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Full windows and rests of all documents, and how many rests hold each id (``doc_id``; ``length`` rests).

    ``with_ids``: full windows carry their ids as well.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        ids_end = max(encode.whole.get_vocab_size(), end + 1)
        # two byte ids take half the room
        kind = "<u2" if ids_end <= 1 << 16 else "<u4"
        near_of, far_of = hashes(ids_end)
        number, seen = -1 - (TaskContext.get().partitionId() << 32), np.zeros(0, dtype=np.int64)
        for batch in batches:
            rows, held = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode.ids(text or ""), np.uint32(end)).astype("<u4")
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    part = ids[at:at + window]
                    rows.append((FULL, doc, at, window, zlib.crc32(part.tobytes()), len(ids), number, None, None,
                                 part.astype(kind).tobytes() if with_ids else None))
                    number -= 1
                if whole < len(ids):
                    rest = ids[whole:]
                    held.append(np.unique(rest))
                    rows.append((REST, doc, whole, len(rest), zlib.crc32(rest.tobytes()), len(ids), None,
                                 int(near_of[held[-1]].min()), int(far_of[held[-1]].min()), rest.astype(kind).tobytes()))
            if held:
                found = np.bincount(np.concatenate(held))
                if len(found) > len(seen):
                    seen = np.r_[seen, np.zeros(len(found) - len(seen), np.int64)]
                seen[:len(found)] += found
            yield _batch(rows, _CUT, _CUT_TYPES)
        at = np.flatnonzero(seen)
        yield _batch([(TERM, t, None, n, None, None, None, None, None, None) for t, n in zip(at.tolist(), seen[at].tolist())],
                     _CUT, _CUT_TYPES)

    return texts(docs).mapInArrow(work, _CUT)


def hashes(ids_end: int) -> list[np.ndarray]:
    """Two hashes of every id; a rest's keys are their least values over its ids."""
    t = np.arange(1, ids_end + 1, dtype=np.uint64)
    return [(t * np.uint64(m) >> np.uint64(24) & np.uint64(0xFFFFFFFF)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Shard:
    """The inverted index of some rests, their BM25 impacts, and which of them are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(ids)
        size = np.array([len(x) for x in ids])
        code, tf = np.unique(np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        term, self.doc = np.divmod(code, n)
        self.impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.bounds = np.r_[first, len(term)]
        postings = np.cumsum(np.r_[False, term[1:] != term[:-1]])  # number of each entry's posting list
        order = np.argsort(self.doc.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
        self.lists, self.weight = postings[order], self.impact[order]
        self.own = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=n))]
        self.unused = np.ones(n, dtype=bool)

    def neighbours(self, seed: int) -> list[int]:
        """Unused rests by falling score for the seed's strongest terms; those without a common term are left out."""
        a, b = self.own[seed], self.own[seed + 1]
        lists = self.lists[a:b]
        if len(lists) > TERMS:
            lists = lists[np.argpartition(self.weight[a:b], -TERMS)[-TERMS:]]
        spans = [slice(self.bounds[x], self.bounds[x + 1]) for x in lists.tolist()]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]),
                            weights=np.concatenate([self.impact[s] for s in spans]), minlength=len(self.unused)) * self.unused
        if len(score) > RETURNED:
            best = np.argpartition(score, -RETURNED)[-RETURNED:]
            best = best[np.argsort(-score[best], kind="stable")]
        else:
            best = np.argsort(-score, kind="stable")
        return [x for x in best.tolist() if score[x] > 0]


def fill(shard: Shard, size: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (rest, first id, ids); the last one may be short. Takes all rests."""
    at = [0] * len(size)  # ids of a rest that earlier windows took
    left = list(size)
    order = sorted(range(len(size)), key=lambda x: -size[x])
    last = 0

    def take(x: int, most: int) -> int:
        n = min(most, left[x])
        made.append((x, at[x], n))
        at[x] += n
        left[x] -= n
        if not left[x]:
            shard.unused[x] = False
        return n

    for seed in order:
        if not left[seed]:
            continue
        made: list[tuple[int, int, int]] = []
        room = window
        room -= take(seed, room)
        while room:
            found = shard.neighbours(seed)
            if not found:  # nothing in common with any: the longest one left
                while last < len(order) and not left[order[last]]:
                    last += 1
                if last == len(order):
                    break
                found = [order[last]]
            taken = [x for x in found if left[x] <= room]
            for x in taken:
                if left[x] <= room:
                    room -= take(x, room)
            if room and not taken:
                room -= take(found[0], room)
        yield made


def fill_windows(idf: np.ndarray, mean: float, window: int, shard: int, with_ids: bool = True):
    """The work of a task: sorted rests in, pieces out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() + 1) << 32
        waiting: list[tuple] = []  # (doc_id, start, doc_tokens, ids)

        def windows(last: bool) -> list[tuple]:
            nonlocal waiting, number
            rows, kind, now = [], waiting[0][3].dtype, waiting
            index = Shard([x[3] for x in now], idf, mean)
            for made in fill(index, [len(x[3]) for x in now], window):
                pieces = [(now[x][0], now[x][1] + a, now[x][2], now[x][3][a:a + n]) for x, a, n in made]
                total = sum(n for _, _, n in made)
                if total < window and not last:
                    waiting = pieces
                    return rows
                if total < window:
                    lengths = [1 << b for b in range(window.bit_length(), -1, -1) if total >> b & 1]
                else:
                    lengths = [window]
                for length in lengths:
                    offset = 0
                    while offset < length:
                        doc, start, tokens, ids = pieces.pop(0)
                        part, rest = ids[:length - offset], ids[length - offset:]
                        if len(rest):
                            pieces.insert(0, (doc, start + len(part), tokens, rest))
                        rows.append((doc, start, len(part), _crc(part), tokens, number, offset,
                                     part.astype(kind).tobytes() if with_ids else None))
                        offset += len(part)
                    number += 1
            waiting = []
            return rows

        for batch in batches:
            kind = None
            for doc, start, tokens, ids, length in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "length")]):
                kind = kind or f"<u{len(ids) // length}"
                waiting.append((doc, start, tokens, np.frombuffer(ids, dtype=kind)))
                if len(waiting) >= shard:
                    yield _batch(windows(False), _PIECE, _PIECE_TYPES)
        if waiting:
            yield _batch(windows(True), _PIECE, _PIECE_TYPES)

    return work


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW, shard: int = SHARD,
                     with_ids: bool = True) -> DataFrame:
    """One row a piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``ids`` are little-endian numbers of two bytes, of four if the vocabulary needs them; null without ``with_ids``. A null text is empty and gives the
    end id alone. Repeated rows and rows without id are documents like any other. No sequence needs padding.
    """
    rows = stored(cut(docs, tokenizer, end, window, with_ids), "cut")
    # one row an id of the vocabulary
    held = rows.filter(F.col("kind") == TERM).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    size = rows.filter(F.col("kind") == REST).agg(F.count("*"), F.sum("length")).first()
    full = rows.filter(F.col("kind") == FULL).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                     F.lit(0).cast("long").alias("offset"), "ids")
    if not size[0]:
        return full
    df = np.zeros(max(r["doc_id"] for r in held) + 1)
    for r in held:
        df[r["doc_id"]] = r["n"]
    idf = np.log(1 + (size[0] - df + 0.5) / (df + 0.5))
    keys = ["near", "far", "doc_id", "start", "ids_crc32", "dealt"]
    rests = (rows.filter(F.col("kind") == REST).select("near", "far", "doc_id", "start", "ids_crc32", "length", "doc_tokens", "ids",
                                                       F.monotonically_increasing_id().alias("dealt"))
             .repartitionByRange(*keys).sortWithinPartitions(*keys))
    return rests.mapInArrow(fill_windows(idf, size[1] / size[0], window, shard, with_ids), _PIECE).unionByName(full)
