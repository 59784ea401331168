"""Exact medians, quantiles and modes of groups of any size.

Values are first counted, which collapses a large group to its distinct values
before the shuffle. Ranks are then found with a prefix sum on two levels: within
a slice of the value range, and over the slices. No task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    slice_of: Column) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation between order statistics.

    ``slice_of`` is a non-decreasing expression of the value with a bounded number
    of results, for example floor(value / 100).
    """
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull())
               .groupBy(*keys, slice_of.alias("_slice"), F.col(value).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")))
    inside = (Window.partitionBy(*keys, "_slice").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", F.sum("_c").over(inside))
    slices = counted.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_n"))
    so_far = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = (slices.withColumn("_run", F.sum("_n").over(so_far))
               .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
               .select(*keys, "_slice", (F.col("_run") - F.col("_n")).alias("_off"), "_total"))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in probs])
    position = (F.col("_total") - 1) * F.col("_w.q")
    low, high = F.floor(position), F.ceil(position)
    first = F.col("_off") + F.col("_upto") - F.col("_c")
    last = F.col("_off") + F.col("_upto") - 1
    holds = lambda rank: (rank >= first) & (rank <= last)
    hits = (
        ranked.join(offsets, [*keys, "_slice"])
        .withColumn("_w", F.explode(wanted))
        .filter(holds(low) | holds(high))
        .select(*keys, F.col("_w.q").alias("prob"), (position - low).alias("_part"),
                F.when(holds(low), F.col("_v")).alias("_lo"),
                F.when(holds(high), F.col("_v")).alias("_hi"))
    )
    return (hits.groupBy(*keys, "prob")
            .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_part").alias("_part"))
            .select(*keys, "prob",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("quantile")))


def group_median(df: DataFrame, keys: Sequence[str], value: str, slice_of: Column,
                 name: str) -> DataFrame:
    rows = group_quantiles(df, keys, value, [0.5], slice_of)
    return rows.select(*keys, F.col("quantile").alias(name))


def group_mode(df: DataFrame, keys: Sequence[str], rank: Column, name: str) -> DataFrame:
    """Most frequent non-null value per group; the lowest value wins a tie."""
    counted = (df.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
               .groupBy(*keys, "_rank").agg(F.count(F.lit(1)).alias("_c")))
    return counted.groupBy(*keys).agg(
        F.max_by("_rank", F.struct("_c", -F.col("_rank"))).alias(name))
