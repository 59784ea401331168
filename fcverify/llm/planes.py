"""Token ids in bit planes.

Ids are written in blocks of a fixed size: bit b of all ids of a block is one plane, each
plane is compressed with zstandard, and a plane without a set bit takes no space. A chunk is
a run of whole documents as bytes:

    magic, version, ids a block, number of ids, number of documents
    number of ids of each document
    chunk index: for each block the number of planes, for each plane its length in bytes
    the planes

Numbers are little-endian. Chunks are rows of a Parquet table with their shard, place and
first id, so that Spark writes, commits and reads them in any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored, texts
from fcverify.llm.tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END = 2
# Ids of a block, and ids from which a chunk is closed.
BLOCK, CHUNK = 1 << 16, 1 << 19
MAGIC, VERSION = b"BPTK", 1
_HEAD = struct.Struct("<4sIIQQ")


def pack_block(ids: np.ndarray, level: int = 1) -> list[bytes]:
    """Compressed planes of a block, from the lowest bit to the highest one that is set."""
    press = zstandard.ZstdCompressor(level=level)
    planes = []
    for bit in range(int(ids.max(initial=0)).bit_length()):
        plane = ids >> np.uint32(bit) & np.uint32(1)
        planes.append(press.compress(np.packbits(plane.astype(bool)).tobytes()) if plane.any() else b"")
    return planes


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    read = zstandard.ZstdDecompressor()
    ids = np.zeros(n, dtype=np.uint32)
    for bit, plane in enumerate(planes):
        if plane:
            ids |= np.unpackbits(np.frombuffer(read.decompress(plane), np.uint8), count=n).astype(np.uint32) << np.uint32(bit)
    return ids


def write_chunk(ids: np.ndarray, lengths: list[int], block: int = BLOCK) -> bytes:
    blocks = [pack_block(ids[at:at + block]) for at in range(0, len(ids), block)]
    index = np.array([x for planes in blocks for x in (len(planes), *map(len, planes))], dtype="<u4").tobytes()
    return b"".join([_HEAD.pack(MAGIC, VERSION, block, len(ids), len(lengths)), np.array(lengths, dtype="<u8").tobytes(),
                     index, *[p for planes in blocks for p in planes]])


def read_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the documents' lengths. A chunk that is not one raises ValueError."""
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a chunk of bit planes")
    _, version, block, n, docs = _HEAD.unpack_from(data)
    if version != VERSION:
        raise ValueError(f"chunk version {version} is not known")
    lengths = np.frombuffer(data, "<u8", docs, _HEAD.size)
    at, sizes = _HEAD.size + 8 * docs, []
    for _ in range(-(-n // block)):
        planes = int(np.frombuffer(data, "<u4", 1, at)[0])
        sizes.append(np.frombuffer(data, "<u4", planes, at + 4).tolist())
        at += 4 + 4 * planes
    ids = np.empty(n, dtype="<u4")
    for number, own in enumerate(sizes):
        planes = []
        for size in own:
            planes.append(data[at:at + size])
            at += size
        part = ids[number * block:(number + 1) * block]
        part[:] = unpack_block(planes, len(part))
    return ids, lengths


_CHUNK = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, data binary"


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """The chunk table, written: every document's ids and the end id, in ascending ``doc_id`` order.

    Null ids come first, rows of one id in the order of their texts; a null text is empty.
    ``shard`` is a range of ids, ``first`` the ids of the shard before the chunk.
    """
    spark = ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        parts, lengths, names, n, chunk, first = [], [], [], 0, 0, 0

        def close():
            data = write_chunk(np.concatenate(parts), lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["shard", "chunk", "first", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode.ids(text or ""), np.uint32(end)).astype("<u4")
                parts.append(ids)
                lengths.append(len(ids))
                names.append(doc)
                n += len(ids)
                if n >= CHUNK:
                    yield close()
                    first, chunk = first + n, chunk + 1
                    parts, lengths, names, n = [], [], [], 0
        if names:
            yield close()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(work, _CHUNK), "chunks")


def read_documents(chunks: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, decoded from the chunk table."""
    # one row a shard: the ids of the shards before it
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
               .select("shard", F.coalesce(before, F.lit(0)).alias("base")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, docs, data = (batch.column(c)[row].as_py() for c in ("shard", "first", "doc_ids", "data"))
                ids, lengths = read_chunk(data)
                lengths = lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(first + ends - lengths),
                     pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = chunks.select("shard", "first", "doc_ids", "data").mapInArrow(
        work, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table that was written to ``path``."""
    return ready(spark).read.parquet(path)
