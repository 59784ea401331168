"""Best-fit packing of tokenised documents, certified by lower bounds.

Pieces are dealt to partitions by hash, and each partition packs its pieces by best-fit
decreasing over counts of lengths. Dual feasible functions give a lower bound on the bins
that a partition needs; one that meets it is certified and rests. The others give the
documents of their unfilled bins back; these are dealt anew, to fewer partitions, and
packed again. A round counts only if it saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored, texts
from fcverify.llm.tokens import encoder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
# Pieces of a partition, and rounds of repacking.
PIECES, ROUNDS = 200_000, 3

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only if longer than ``capacity``.

    A longer one is cut into full pieces with the rest in front. A null text is empty and
    gives the end id alone.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode.ids(text or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, number, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(work, _PIECE)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces with ``counts[length]`` need at least; the capacity is the last index.

    The best of three families of dual feasible functions: the identity; those that round
    lengths above half a bin up against a threshold and drop lengths below it; and those that
    round multiples of 1 / (k + 1) bins. Any sum of such values over a bin is at most 1.
    """
    capacity = len(counts) - 1
    length = np.arange(capacity + 1)
    best = -(-int((length * counts).sum()) // capacity)
    number, volume = np.cumsum(counts), np.cumsum(length * counts)
    for t in range(1, capacity // 2 + 1):  # above capacity - t: 1; from t on: the share; below t: 0
        large = int(number[capacity] - number[capacity - t])
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):
        value = np.where((k + 1) * length % capacity == 0, length * k, (k + 1) * length // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins.

    Lengths in decreasing order, all pieces of one length at a time: the fullest bins that
    still fit take as many as fit, as they would one by one.
    """
    order = np.argsort(-length, kind="stable")
    bin_of, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    room: dict[int, list[np.ndarray]] = {}
    bins = 0
    sizes, starts = np.unique(-length[order], return_index=True)
    ends = [*starts[1:], len(order)]

    def place(items, into, residual, size, each):
        """items go into bins ``into`` with ``residual`` room, ``each`` to a bin."""
        nth = np.arange(len(items))
        bin_of[items] = into[nth // each]
        offset[items] = capacity - residual + nth % each * size
        full, rest = divmod(len(items), each)
        if full:
            room.setdefault(residual - each * size, []).append(into[:full])
        if rest:
            room.setdefault(residual - rest * size, []).append(into[full:full + 1])
            full += 1
        return into[full:]

    for size, a, b in zip(-sizes, starts, ends):
        size, items = int(size), order[a:b]
        for residual in sorted(r for r in room if r >= size):
            if not len(items):
                break
            into = np.concatenate(room.pop(residual))
            if len(into):
                each = residual // size
                n = min(len(items), each * len(into))
                if len(left := place(items[:n], into, residual, size, each)):
                    room.setdefault(residual, []).append(left)
                items = items[n:]
        if len(items):
            each = capacity // size
            n = -(-len(items) // each)
            place(items, np.arange(bins, bins + n), capacity, size, each)
            bins += n
    return bin_of, offset, bins


_PACKED = f"{_PIECE}, part long, bin long, offset long, room long, gap long"


def _packed(rows: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """``rows`` (pieces) packed in ``parts`` partitions; ``room`` is left in the bin, ``gap`` is bins above the bound."""
    def pack(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        bin_of, offset, bins = best_fit_decreasing(length, capacity)
        gap = bins - lower_bound(np.bincount(length, minlength=capacity + 1))
        room = capacity - np.bincount(bin_of, weights=length, minlength=bins).astype(np.int64)
        columns = {"bin": bin_of, "offset": offset, "room": room[bin_of], "gap": np.full(len(length), gap)}
        for name, value in columns.items():
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table.select([f.split()[0] for f in _PACKED.split(", ")])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed), F.monotonically_increasing_id() % 64),
                                           F.lit(parts)) + F.lit(seed << 32))
    return dealt.groupBy("part").applyInArrow(pack, _PACKED)


def pack(rows: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``part`` and ``bin``, their sequence, and ``offset``, their place in it.

    Full pieces are sequences of their own. Repeated rows are pieces like any other.
    """
    full = rows.filter(F.col("length") == capacity).select(
        *rows.columns, F.lit(-1).cast("long").alias("part"), F.monotonically_increasing_id().alias("bin"),
        F.lit(0).cast("long").alias("offset"))
    part = stored(rows.filter(F.col("length") < capacity), "pieces")
    now = stored(_packed(part, -(-part.count() // per_part) or 1, 1, capacity), "packed")
    resting = []
    for seed in range(2, 2 + rounds):
        open_rows = now.filter("gap > 0 and room > 0")
        before = open_rows.agg(F.count("*"), F.count_distinct("part", "bin"), F.count_distinct("part")).first()
        if before[2] < 2:  # one partition alone has nobody to exchange with
            break
        again = stored(_packed(open_rows.select(*rows.columns), min(-(-before[0] // per_part), before[2] - 1), seed, capacity), "packed")
        if again.select("part", "bin").distinct().count() >= before[1]:
            break
        resting.append(now.filter("not (gap > 0 and room > 0)"))
        now = again
    for rest in resting:
        now = now.unionByName(rest)
    return now.select(*rows.columns, "part", "bin", "offset").unionByName(full)


def packed_documents(docs: DataFrame) -> DataFrame:
    """One row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    rows = stored(pieces(docs), "tokens")
    numbered = F.when(F.col("part") < 0, -1 - F.col("bin")).otherwise(
        (F.shiftright("part", 32) * (1 << 20) + F.col("part").bitwiseAND(0xFFFFF)) * (1 << 38) + F.col("bin"))
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", numbered.alias("sequence_id"), "offset")
