"""Reproducible samples and temporal splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.schema import TRAIN_END, VALIDATION_END


def hash_percent(time: Column) -> Column:
    """0..99 from an observation time; all stations at one time get the same value."""
    return F.pmod(F.xxhash64(time), F.lit(100))


def minute_percent(time: Column) -> Column:
    """0..99 from a time by integer arithmetic alone, the same in any SQL engine."""
    minute = F.floor(F.unix_seconds(time) / F.lit(60))
    return F.pmod(F.pmod(minute, F.lit(1_000_003)) * 7919, F.lit(100))


def issue_hour_percent(time: Column) -> Column:
    hour = F.floor(F.unix_seconds(time) / F.lit(3600))
    return F.pmod(F.abs(hour), F.lit(100))


def keep_percent(df: DataFrame, percent: Column, keep: int | None) -> DataFrame:
    return df if keep is None or keep >= 100 else df.filter(percent < keep)


def fixed_size_sample(df: DataFrame, n: int, order: Column, *tie: str) -> DataFrame:
    """n rows with the smallest hash. A top-k: partitions keep n rows each, then merge."""
    return df.orderBy(order, *tie).limit(n)


def split_name(t0: Column, train_end: str = TRAIN_END, validation_end: str = VALIDATION_END) -> Column:
    """train, val or test by issue time."""
    return (
        F.when(t0 < F.lit(train_end).cast("timestamp"), "train")
        .when(t0 < F.lit(validation_end).cast("timestamp"), "val")
        .otherwise("test")
    )
