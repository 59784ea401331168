"""Registered queries: one entry per operator, with its oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fcverify.fixtures import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output form shared with the oracle: zone-less timestamps, rounded doubles."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            columns.append(F.col(field.name).cast("timestamp_ntz").alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            columns.append(F.round(F.col(field.name).cast("double"), 6).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def rounded(*names: str) -> str:
    """SELECT items for doubles, rounded as ``plain`` rounds them."""
    return ", ".join(f"round(cast({n} as double), 6) as {n}" for n in names)


def register(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a function of ``Views`` as query ``name``."""

    def wrap(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark, sf_dir: str) -> DataFrame:
            return plain(build(Views(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return build

    return wrap


def load() -> None:
    """Import every catalog module once."""
    from fcverify.catalog import (  # noqa: F401
        ensembles, feature_frames, ingest, learning, scores, serving_queries,
        streams, verify)
