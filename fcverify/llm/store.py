"""Intermediate tables in the shared folder, and the settings Arrow stages rely on."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fcverify.session import checkpoint_folder, prepare

# Rows of an Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS = "512"
# Bits that are folded together, and the least size of a filter.
SLICE = 1 << 15
# Shuffle files go when the query that wrote them has ended. Left to the driver's garbage collection they stay as long
# as its heap has room, which does not follow the size of the input. A stage whose files are gone can be run again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    return spark


def stored(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. Without ``compression`` the session's codec holds.

    Later steps read the files, so a lost executor repeats one step at most and
    nothing below is computed twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ragged(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as slices of its values."""
    out = []
    for chunk in column.chunks:
        at, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        out += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; further columns, whatever they are called, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bit_slices(bits: DataFrame) -> dict[int, bytes]:
    """The set bits of a filter, a column ``bit`` of different numbers, by slices that are packed where they are made.

    Few set bits take few bytes, so what the driver gets and sends on grows with them and not with the filter.
    """
    def fold(table: pa.Table) -> pa.Table:
        own = np.zeros(SLICE, dtype=bool)
        own[table.column("bit").to_numpy() % SLICE] = True
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()),
                         "bits": pa.array([zlib.compress(np.packbits(own).tobytes())], pa.binary())})

    sliced = bits.withColumn("slice", F.shiftright("bit", SLICE.bit_length() - 1))
    found = sliced.groupBy("slice").applyInArrow(fold, "slice long, bits binary").toArrow()
    return dict(zip(found.column("slice").to_pylist(), found.column("bits").to_pylist()))


def whole_filter(slices: dict[int, bytes], size: int) -> bytes:
    """The filter of ``size`` bits, in a task; bits of slices that are missing are not set."""
    whole = bytearray(size // 8)
    for at, own in slices.items():
        whole[at * SLICE // 8:(at + 1) * SLICE // 8] = zlib.decompress(own)
    return bytes(whole)
