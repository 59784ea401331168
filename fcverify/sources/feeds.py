"""Landed message feeds: observation CSV, bulk CSV, granule folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION_CSV = "station string, valid string, metar string"
# Positional columns: station, year, month, day, hour, minute, text.
BULK_CSV = "station string, year string, month string, day string, hour string, minute string, report string"


def _in_window(df: DataFrame, column: str, start, end) -> DataFrame:
    time = F.col(column)
    return df.filter((time >= F.lit(start).cast("timestamp")) & (time < F.lit(end).cast("timestamp")))


def shape_observations(rows: DataFrame, start, end, source: str = "iem") -> DataFrame:
    """Raw observations from (station, valid, metar) text rows.

    Blank messages and unreadable times are dropped, the window is half open.
    """
    shaped = rows.select(
        F.col("station").alias("icao"),
        F.try_to_timestamp(F.trim("valid"), F.lit("y-M-d H:m")).alias("observed_at"),
        F.trim("metar").alias("raw_text"), F.lit(source).alias("source"))
    shaped = shaped.filter((F.col("raw_text") != "") & F.col("observed_at").isNotNull())
    return _in_window(shaped, "observed_at", start, end)


def read_observation_csv(spark: SparkSession, path, start, end, source: str = "iem") -> DataFrame:
    rows = spark.read.option("header", True).schema(OBSERVATION_CSV).csv(path)
    return shape_observations(rows, start, end, source)


def _bulk_time() -> Column:
    number = lambda c: F.col(c).try_cast("int")
    return F.try_make_timestamp(number("year"), number("month"), number("day"), number("hour"), number("minute"),
                                F.lit(0).cast("decimal(8,6)"))


def shape_bulk(rows: DataFrame, icaos: Sequence[str] | None, start, end) -> DataFrame:
    """(icao, at, raw_text) of the wanted stations from positional bulk rows.

    Short rows, the header and malformed dates have no time and fall out; the
    closing ``=`` of a message is removed.
    """
    text = F.trim(F.rtrim(F.trim("report"), F.lit("=")))
    wanted = rows if icaos is None else rows.filter(F.col("station").isin(*icaos))
    shaped = wanted.select(F.col("station").alias("icao"), _bulk_time().alias("at"), text.alias("raw_text"))
    shaped = shaped.filter(F.col("at").isNotNull() & (F.col("raw_text") != ""))
    return _in_window(shaped, "at", start, end)


def bulk_forecasts(rows: DataFrame, source: str = "ogimet") -> DataFrame:
    """Raw forecast records; validity is filled when the text is decoded."""
    empty = F.lit(None).cast("timestamp")
    return rows.select("icao", F.col("at").alias("issued_at"), empty.alias("valid_from"), empty.alias("valid_to"),
                       "raw_text", F.lit(source).alias("source"))


def bulk_observations(rows: DataFrame, source: str = "ogimet") -> DataFrame:
    return rows.select("icao", F.col("at").alias("observed_at"), "raw_text", F.lit(source).alias("source"))


def icao_prefix(icao: Column) -> Column:
    """Region prefix a granule is keyed by."""
    return F.upper(F.substring(icao, 1, 2))


def read_granules(spark: SparkSession, root: str, icaos: Sequence[str], start, end) -> DataFrame:
    """Bulk rows of the stations from a folder laid out as prefix=XX/year=YYYY.

    Only folders of the stations' prefixes and the years the window touches are
    listed and read; the window itself is applied to the rows.
    """
    prefixes = sorted({i[:2].upper() for i in icaos})
    first, last = (F.year(F.lit(t).cast("timestamp")) for t in (start, end))
    # the rows have a year of their own, which goes by another name beside the folder's
    columns = BULK_CSV.replace("year string", "row_year string")
    files = (spark.read.schema(columns + ", prefix string, year int")
             .csv(root).filter(F.col("prefix").isin(*prefixes))
             .filter(F.col("year").between(first, last))
             .drop("year").withColumnRenamed("row_year", "year"))
    return shape_bulk(files, list(icaos), start, end)


def granule_audit(lines: DataFrame, granule: str = "granule", text: str = "value") -> DataFrame:
    """Granules worth keeping: more than one line and a forecast somewhere in them."""
    return (lines.groupBy(granule)
            .agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.col(text).contains("TAF")).alias("has_taf"))
            .withColumn("keep", (F.col("n_lines") > 1) & F.col("has_taf")))


def audit_folder(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("granule"))
    return granule_audit(lines)
