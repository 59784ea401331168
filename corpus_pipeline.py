"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fcverify.llm import golay, langid, linededup, mixing, overlap, packing
from fcverify.llm.store import ready, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, trained on the stage's own labelled rows, recognises."""
    ready(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals. ``n_chars`` follows the text."""
    out = linededup.dedup(docs).drop("kept_lines", "equal_lines", "near_lines")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: first by SimHash, as op4 links them, then of what is left by
    five-word shingles, with a Jaccard similarity of 0.8 or more."""
    rest = stored(golay.keep_first(docs), "simhash", "zstd")
    return golay.keep_first(rest, overlap.near_duplicates, overlap.code)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the result is the table of the last one."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


# The first stage is a trained model, which SQL cannot state; tests compare the stages with brute force.
ORACLE_SQL = None
