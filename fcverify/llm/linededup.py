"""Line deduplication by a deletion-neighbourhood join.

The unit of a line is its words, the edit bound is one word: put in, taken out or
exchanged. A line emits itself without each of its words as hashed keys. Lines of one
length that share the key of one position differ in that word alone; a line whose own key
is another's key is that other line without a word. Equal keys are folded to their
earliest line before they meet the others by equality, so no pairs are made, and each
link found is verified on the words themselves.

Every line that has an earlier one within the bound goes; the earliest stays. Earlier is
by ``doc_id``, then by a hash of the text, then by the place in it. Lines under
``MIN_WORDS`` words must be equal: one word of so few says too much. Blank lines stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fcverify.llm.store import bit_slices, freed, ready, stored, texts, whole_filter
from fcverify.llm.words import utf8

MIN_WORDS = 5
# Bits of the filter that says which lines can have a neighbour at all; 16 MB, whatever the input.
FILTER_BITS = 1 << 27
# Different lines that a task holds.
HELD = 30_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = [np.uint64(pow(base, -1, 1 << 64)) for base in _BASES]


def within_one(a: list, b: list) -> bool:
    """Whether one word put in, taken out or exchanged turns ``a`` into ``b``, or none."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def halves(words: list[bytes]) -> list[int]:
    """Hashes of halves: first and last one as a line of this length, then as the shorter one of a pair.

    Of a pair within the bound, N words the longer one, either the first N // 2 words agree
    or the last N - 1 - N // 2. So two lines of one length share one of their first two
    hashes, and a line's first two meet the last two of a line a word shorter.
    """
    out = []
    for n in (len(words), len(words) + 1):
        half = n // 2
        out.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 2 * n))
        out.append(xxhash.xxh64_intdigest(b" ".join(words[len(words) - (n - 1 - half):]), 2 * n + 1))
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in _BASES]


def _variants(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines with a word: their lengths, the place of every word in its line, 128-bit hashes (as rows of two) of the lines,
    and of the lines without each word in turn.

    A polynomial over the words' hashes, whose sums run over all lines at once.
    """
    n = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    start = np.cumsum(n) - n
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(lines))), dtype="<u8").reshape(-1, 2)
    place = np.arange(len(h)) - np.repeat(start, n)
    own, without = np.empty((len(n), 2), dtype=np.uint64), np.empty((len(h), 2), dtype=np.uint64)
    for c, power in enumerate(_powers(1 << int(n.max()).bit_length())):
        part = h[:, c] * power[place]
        run = np.cumsum(part)
        upto = run - np.repeat(run[start] - part[start], n)
        own[:, c] = upto[start + n - 1]
        without[:, c] = upto - part + (np.repeat(own[:, c], n) - upto) * _INVERSES[c]
    return n, place, own, without


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line itself (first) and of the line without each word in turn."""
    _, _, own, without = _variants([words])
    return np.concatenate([own, without])


def _lines(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    for number, line in enumerate(utf8(text).split(b"\n")):
        if words := line.split():
            yield number, words


_LINE = "doc_id long, th long, line int, h1 long, h2 long, p array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _identified(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("th", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """Every line with a word: its place, a 128-bit hash of its words, and its halves' hashes if it is long enough.

    The halves serve to tell different lines apart, so a task gives those of equal lines once.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) > HELD:
                seen = set()
            rows = []
            for doc, text, th in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "th"))):
                for number, words in _lines(text):
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype="<i8").tolist()
                    p = None
                    if len(words) >= MIN_WORDS - 1 and (a, b) not in seen:
                        seen.add((a, b))
                        p = list(map(_signed, halves(words)))
                    rows.append((doc, th, number, a, b, p))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["doc_id", "th", "line", "h1", "h2", "p"])

    return _identified(docs).mapInArrow(work, _LINE)


def _filter(lines: DataFrame) -> dict[int, bytes]:
    """Two bits for each half that makes a line worth its keys: another line of the same length has it, or one of the other length.

    The size is fixed; more set bits only let more lines through.
    """
    halved = lines.filter("p is not null").select("h1", F.posexplode("p").alias("i", "p"))
    longer = F.col("i") < 2
    met = (halved.groupBy("p").agg(F.min(F.when(longer, F.col("h1"))).alias("a"), F.max(F.when(longer, F.col("h1"))).alias("b"),
                                   F.max(F.when(~longer, 1)).alias("shorter"))
           .select(F.pmod("p", F.lit(FILTER_BITS // 2)).alias("bit"), (F.col("a") < F.col("b")).alias("same"),
                   F.expr("a is not null and shorter = 1").alias("other")))
    bits = met.select(F.explode(F.array(F.when(F.col("same"), 2 * F.col("bit")), F.when(F.col("other"), 2 * F.col("bit") + 1))).alias("bit"))
    return bit_slices(bits.filter("bit is not null").distinct())


_KEY = "doc_id long, th long, line int, kind int, k1 long, k2 long, words string"


def keys_of(lines: list[list[bytes]], same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, kind and key of the keys of some lines, given which of their halves (columns) other lines have.

    kind 0: the line without the word at a place, for lines of its length; 1: the same for
    lines a word shorter; 2: the line itself. Where the first half agrees the edit is in the
    second, and the other way round, so only those places give keys.
    """
    n, place, own, without = _variants(lines)
    line, half = np.repeat(np.arange(len(n)), n), np.repeat(n // 2, n)
    near = [((place >= half) & known[line, 0]) | ((place <= half) & known[line, 1]) for known in (same, other)]
    swapped = without[near[0]].view(np.int64)
    swapped[:, 0] ^= (place[near[0]] + 1) * np.int64(0x5851F42D4C957F2D)
    kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(swapped), near[1].sum(), len(n)])
    return (np.concatenate([line[near[0]], line[near[1]], np.arange(len(n))]), kinds,
            np.concatenate([swapped, without[near[1]].view(np.int64), own.view(np.int64)]))


def line_keys(words: list[bytes], same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and keys of one line."""
    return keys_of([words], same[None], other[None])[1:]


def _variant_table(docs: DataFrame, chosen) -> DataFrame:
    """Keys of the lines that pass the filter; each line's words once, with kind 2.

    Of equal lines that a task meets while it holds less than HELD lines only the earliest
    gives keys: the others have an earlier equal line and go for that.
    """
    def emit(held: dict) -> pa.RecordBatch:
        found = np.array([f for _, f in held.values()], dtype=bool)
        of, kind, key = keys_of([line.split(b" ") for line in held], found[:, :2], found[:, 2:])
        places = [o for o, _ in held.values()]
        columns = [pa.array([o[i] for o in places], t).take(pa.array(of)) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
        own = pa.array([line.decode("utf-8", "replace") for line in held], pa.string()).take(pa.array(of, mask=kind != 2))
        return pa.RecordBatch.from_arrays([*columns, pa.array(kind), pa.array(key[:, 0]), pa.array(key[:, 1]), own],
                                          names=["doc_id", "th", "line", "kind", "k1", "k2", "words"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = whole_filter(chosen.value, FILTER_BITS), {}
        for batch in batches:
            for doc, text, th in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "th"))):
                for number, words in _lines(text):
                    if len(words) < MIN_WORDS - 1:
                        continue
                    o, line = (doc is not None, doc, th, number), b" ".join(words)
                    if line in held:
                        if o < held[line][0]:
                            held[line] = (o, held[line][1])
                        continue
                    # the two bits of a half stand side by side, first that of its own length
                    slot = [2 * (h % (FILTER_BITS // 2)) for h in halves(words)]
                    two = [bits[x >> 3] >> (6 - (x & 7)) & 3 for x in slot]
                    found = (two[0] & 2, two[1] & 2, two[0] & 1, two[1] & 1)
                    if any(found) or (two[2] | two[3]) & 1:
                        held[line] = ((o[0], doc, th, number), found)
                if len(held) >= HELD:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    return _identified(docs).mapInArrow(work, _KEY)


def _place(*names: str) -> Column:
    return F.struct(*names)


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id``, ``th``, ``line`` of the lines that have an earlier, different one within the bound; stored."""
    chosen = docs.sparkSession.sparkContext.broadcast(_filter(lines))
    keys = stored(_variant_table(docs, chosen).select(_place("doc_id", "th", "line").alias("o"), "kind", "k1", "k2", "words"), "variants")
    chosen.destroy()
    rows = keys.select("o", "kind", "k1", "k2")
    swapped, moved = rows.filter("kind = 0"), rows.filter("kind > 0")
    least = swapped.groupBy("k1", "k2").agg(F.min("o").alias("e"), F.count("*").alias("n")).filter("n > 1").drop("n")
    sides = moved.groupBy("k1", "k2").agg(*[F.min(F.when(F.col("kind") == k, F.col("o"))).alias(f"m{k}") for k in (1, 2)])
    sides = sides.filter("m1 is not null and m2 is not null")
    found = (swapped.join(least, ["k1", "k2"]).select("o", "e")
             .unionByName(moved.join(sides, ["k1", "k2"]).select("o", F.when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1")).alias("e")))
             .filter("e < o").distinct())
    own = keys.filter("kind = 2").select("o", "words")

    def same(a: Column, b: Column) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"]) & (a["line"] == b["line"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            good = [min(len(x := a.split(" ")), len(y := b.split(" "))) >= MIN_WORDS - 1 and max(len(x), len(y)) >= MIN_WORDS
                    and within_one(x, y) for a, b in pairs]
            yield batch.filter(pa.array(good, pa.bool_())).select(["doc_id", "th", "line"])

    left = own.select(F.col("o").alias("lo"), F.col("words").alias("a"))
    right = own.select(F.col("o").alias("ro"), F.col("words").alias("b"))
    pairs = (found.join(left, same(F.col("o"), F.col("lo"))).join(right, same(F.col("e"), F.col("ro")))
             .select("o.doc_id", "o.th", "o.line", "a", "b"))
    near = stored(pairs.mapInArrow(verify, "doc_id long, th long, line int").distinct(), "near")
    freed(keys)
    return near


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` and the places of the lines that go: ``equal`` to an earlier one, and ``near`` one only; stored."""
    table = stored(line_table(docs), "lines")
    lines = table.select("h1", "h2", _place("doc_id", "th", "line").alias("o"), "p")
    first = lines.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    equal = (lines.select("h1", "h2", "o").join(first, ["h1", "h2"]).filter("first < o")
             .select("o.doc_id", "o.th", "o.line", F.lit(True).alias("equal")))
    near_table = near_lines(docs, lines)
    near = near_table.withColumn("equal", F.lit(False))
    each = equal.unionByName(near).groupBy("doc_id", "th", "line").agg(F.max("equal").alias("equal"))
    gone = stored(each.groupBy("doc_id", "th").agg(F.collect_list(F.when(F.col("equal"), F.col("line"))).alias("equal"),
                                                   F.collect_list(F.when(~F.col("equal"), F.col("line"))).alias("near")), "gone")
    freed(table, near_table)
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without the lines that go, and ``kept_lines``, ``equal_lines``, ``near_lines``.

    Blank lines are not counted and stay. A null text stays null. Of rows that repeat id and
    text, all but one lose every line with a word. ``kept_lines`` and so on are put behind the
    columns of ``docs`` under these names, in this order.
    """
    ready(docs.sparkSession)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    gone = dropped_lines(docs).withColumnsRenamed({"doc_id": "row_id", "th": "row_th"})
    flat = docs.select(*[F.col(c).alias(a) for a, c in zip(columns, docs.columns)], F.col("doc_id").cast("long").alias("row_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("row_th"))
    # a missing id is a number and a mark, so that the join and the window deal the texts alike, and once
    row = [F.coalesce("row_id", F.lit(0)).alias("k_id"), F.isnull("row_id").alias("k_none"), F.col("row_th").alias("k_th")]
    flat = flat.select(*columns, *row)
    gone = gone.select("equal", "near", *row)
    keys = ["k_id", "k_none", "k_th"]
    # lists of places look small beside the memory they take, so they are never broadcast
    joined = (flat.join(gone.hint("merge"), keys, "left")
              .withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).drop(*keys))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (columns[at], "equal", "near", "copy")))
            for text, equal, near, copy in rows:
                gone, kept, n, lost = {*(equal or ()), *(near or ())}, [], 0, 0
                for number, line in enumerate((text or "").split("\n")):
                    worded = bool(utf8(line).split())
                    if worded and copy > 1:
                        lost += 1
                    elif number not in gone:
                        kept.append(line)
                        n += worded
                out.append(None if text is None else "\n".join(kept))
                counts.append((n, lost if copy > 1 else len(equal or ()), 0 if copy > 1 else len(near or ())))
            arrays = [pa.array(out, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(columns))]
            arrays += [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [()] * 3)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "k0", "k1", "k2"])

    schema = T.StructType([T.StructField(a, f.dataType) for a, f in zip(columns, docs.schema.fields)]
                          + [T.StructField(k, T.LongType()) for k in ("k0", "k1", "k2")])
    return joined.mapInArrow(cut, schema).toDF(*docs.columns, "kept_lines", "equal_lines", "near_lines")
