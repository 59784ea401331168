"""Sharding by sampled splitters: near equal bytes, equal texts together.

The key of a row is a hash of its text, so equal texts are neighbours. A size-weighted
sample gives the quantiles of the keys; they cut the key space into many small ranges, whose
bytes are then summed exactly. Ranges that turn out overfull are sampled and cut again; one
that holds a single key is dealt out by a second hash. Each shard takes one run of ranges,
and whole groups of equal texts that are large; only a group of over half a shard is
spread over shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored

SHARDS = 16
# Ranges and sample rows for each shard, rounds of cutting, and a range's bytes over the mean that call for it.
RANGES, SAMPLE, ROUNDS, OVERFULL = 128, 2048, 3, 2.0


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``key`` and ``tie`` of every row. A null text has no bytes, as an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
                       F.xxhash64("text").alias("key"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie"))


def _sample(rows: DataFrame, total: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of about ``wanted`` rows, drawn in proportion to size; rows above the step come in any case.

    No more than twice ``wanted`` rows are expected, whatever the input.
    """
    step = max(1, total // wanted)
    chance = F.pmod(F.xxhash64("tie", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    drawn = (rows.filter(chance * step < F.col("size")).select("key", F.greatest("size", F.lit(step)).alias("w")).toArrow())
    return drawn.column("key").to_numpy(), drawn.column("w").to_numpy()


def _cut(key: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """Splitters about every ``share`` of weight; a key that has half of that on its own is cut out."""
    keys, at = np.unique(key, return_inverse=True)
    own = np.bincount(at, weights=weight, minlength=len(keys))
    upto = np.cumsum(own)
    quantile = keys[np.searchsorted(upto, np.arange(share, upto[-1] if len(upto) else 0, share))] if len(keys) else keys
    heavy = keys[own >= share / 2]
    return np.unique(np.r_[quantile, heavy, heavy[heavy < np.iinfo(np.int64).max] + 1])


def _ranged(rows: DataFrame, splitters: np.ndarray, parts: dict[int, int]) -> DataFrame:
    """``rows`` with ``part``, the range of their key, and ``piece`` in a range of a single key that is dealt out by ``tie``."""
    splitters = np.sort(splitters)
    many = np.ones(len(splitters) + 1, dtype=np.int64)
    for r, n in parts.items():
        many[r] = n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            part = np.searchsorted(splitters, key, side="right")
            piece = (tie.view(np.uint64) >> np.uint64(20)).astype(np.int64) % many[part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int64)), pa.array(piece)],
                                             names=[*batch.schema.names, "part", "piece"])

    return rows.mapInArrow(work, "doc_id long, size long, text_crc32 long, key long, tie long, part long, piece long")


def plan_ranges(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, list]:
    """The rows in their ranges, and for each (part, piece): rows, bytes and whether it holds a single key.

    The number of ranges depends on ``shards`` alone, not on the rows.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    share = max(1.0, total / (shards * RANGES))
    splitters = _cut(*_sample(rows, total, shards * SAMPLE), share)
    for turn in range(ROUNDS + 1):
        sums = _ranged(rows, splitters, {}).groupBy("part").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = {r["part"]: r for r in sums if r["bytes"] > OVERFULL * share and r["n"] > 1}
        wide = [p for p, r in over.items() if r["low"] < r["high"]]
        if not wide or turn == ROUNDS:
            break
        inside = _ranged(rows, splitters, {}).filter(F.col("part").isin(wide))
        more = _cut(*_sample(inside, sum(over[p]["bytes"] for p in wide), min(shards, len(wide)) * SAMPLE), share)
        edges = np.array([x for p in wide for x in (over[p]["low"], over[p]["high"])], dtype=np.int64)
        splitters = np.unique(np.r_[splitters, more, edges])
    parts = {r["part"]: -(-r["bytes"] // int(share)) for r in sums if r["bytes"] > OVERFULL * share and r["low"] == r["high"]}
    ranged = stored(_ranged(rows, splitters, parts), "ranged")
    units = ranged.groupBy("part", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"),
                                                (F.min("key") == F.max("key")).alias("single")).collect()
    return ranged, sorted(units, key=lambda u: (u["part"], u["piece"]))


def deal(units: list, shards: int = SHARDS) -> dict[tuple[int, int], int]:
    """Shard of every unit: large groups first, the largest to the emptiest shard; then runs of ranges.

    A group of equal texts stays whole if it is at most half a shard's share, or if a shard has room for it; else its
    pieces are dealt out, as the shards could not be near equal with it.
    """
    total = sum(u["bytes"] for u in units)
    fair = total / shards
    groups: dict[int, list] = {}
    for u in units:
        groups.setdefault(u["part"], []).append(u)
    filled, shard_of, rest = np.zeros(shards), {}, []
    large = []
    for part, own in groups.items():
        size = sum(u["bytes"] for u in own)
        if own[0]["single"] and size > fair / RANGES * OVERFULL:
            large.append(own)
        else:
            rest += own
    for own in sorted(large, key=lambda own: (-sum(u["bytes"] for u in own), own[0]["part"], own[0]["piece"])):
        size, to = sum(u["bytes"] for u in own), int(filled.argmin())
        whole = size <= fair / 2 or filled[to] + size <= fair
        for u in own:
            to = to if whole else int(filled.argmin())
            shard_of[u["part"], u["piece"]] = to
            filled[to] += u["bytes"]
    # the others in the order of their keys; a shard ends where the next range would lead further from its share
    left, to = sum(u["bytes"] for u in rest), 0
    room = _level(filled, left) - filled
    for u in rest:
        while to < shards - 1 and room[to] < u["bytes"] / 2:
            room[to + 1] += min(0.0, room[to])
            to += 1
        shard_of[u["part"], u["piece"]] = to
        room[to] -= u["bytes"]
    return shard_of


def _level(filled: np.ndarray, more: float) -> np.ndarray:
    """What every shard holds in the end if ``more`` bytes level them out; a shard above the level keeps what it has."""
    order = np.sort(filled)
    for n in range(len(order), 0, -1):
        level = (order[:n].sum() + more) / n
        if level >= order[n - 1]:
            break
    return np.maximum(filled, level)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` (bytes), ``shard``, ``slot`` and ``grown_shard`` (null) of every row.

    Slots number the rows of a shard without gaps: unit by unit, in a unit by key and id. Repeated
    rows are rows of their own.
    """
    spark = ready(docs.sparkSession)
    rows = stored(keyed(docs), "keyed")
    ranged, units = plan_ranges(rows, shards)
    placed = unit_table(spark, units, deal(units, shards))
    # windows over one range each; the table of ranges has a fixed number of rows
    nth = F.row_number().over(Window.partitionBy("part", "piece").orderBy("key", "doc_id", "tie"))
    return (ranged.withColumn("nth", nth).join(placed, ["part", "piece"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def unit_table(spark: SparkSession, units: list, shard_of: dict[tuple[int, int], int]) -> DataFrame:
    """``part``, ``piece``, ``shard`` and ``before``, the rows of the shard in earlier units."""
    counts: dict[int, int] = {}
    table = []
    for u in units:
        to = shard_of[u["part"], u["piece"]]
        table.append((u["part"], u["piece"], to, counts.get(to, 0)))
        counts[to] = counts.get(to, 0) + u["n"]
    return spark.createDataFrame(table, "part long, piece long, shard int, before long")
