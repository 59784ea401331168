"""A boundary in the plan behind which columns are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator. Filters and projections further up are not
    pushed through it, so expensive columns below are evaluated once per row."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
