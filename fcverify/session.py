"""Session settings and lineage cuts."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# SQL settings that can be changed on a running session. Every timestamp rule in
# this package is a UTC rule; the rest lets AQE size partitions, pick broadcast
# joins from measured sizes and split skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A union that passes its children's partitioning on lets a window or join above it skip its exchange, although
    # the children's partitions are not lined up in every plan: rows were lost. Needless where Spark lacks it.
    "spark.sql.unionOutputPartitioning": "false",
    # Averages of 70 features have 140 fields; above this number Spark leaves the generated loop.
    "spark.sql.codegen.maxFields": "400",
}


PACKAGE = "fcverify"

# Call sites in error messages cost a few JVM calls per expression; plans here are long.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return ship(spark)


def build_session(app: str = "fcverify", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a session: they need not have the driver's path."""
    context = spark.sparkContext
    if not any(f.endswith(f"/{PACKAGE}.zip") for f in context.listFiles):
        folder = pathlib.Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp()}/{PACKAGE}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(folder.rglob("*.py")):
                out.write(module, module.relative_to(folder.parent))
        context.addPyFile(archive)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="fcverify-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut as ``checkpoint`` does, but by columns and compressed: for long frames that are read often.

    Rows may come back in other partitions.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
