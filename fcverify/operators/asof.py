"""As-of lookups without a per-station bottleneck.

Spark SQL has no as-of join, and a window over a whole station would put a busy
station's full history in one task. Here time is cut in buckets:

1. copies of an observation time are folded before the first shuffle,
2. buckets that measure more than ``SPLIT_ROWS`` rows are cut again, along slices of
   time whose counts are summed up, so a hot hour becomes as many parts as it needs,
3. every part is seeded with the last observation before it, found from one row
   per station and non-empty part,
4. a window over (station, part) answers the probes of that part.

Lags are answered by sending the observations on, not the probes: an observation
moved by the lag stands before a probe exactly if it stood before the lagged probe.
So a probe is one row whatever the number of lags, and gets all answers at once.

Probes are reduced to distinct keys first and the answers joined back by
equality, so a probe time shared by many rows costs one answer; AQE splits the
join-back partition of such a key because the lookup side is unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.session import checkpoint

BUCKET_SECONDS = 3600
# Rows above which a bucket is cut, and the slices of a bucket that are counted for it. A slice
# holds as many distinct microseconds at most as it is long: 0.88 s of an hour.
SPLIT_ROWS, SLICES = 200_000, 4096
# A cut list of this many rows at most is broadcast; a longer one is joined by shuffling.
CUTS_SENT = 50_000

_HOUR = 3_600_000_000


def _bucket(width: int):
    return F.floor(F.col("_key") / F.lit(width)).alias("_bucket")


def _slice(width: int):
    return F.floor(F.pmod("_key", F.lit(width)) * SLICES / F.lit(width)).cast("int").alias("_slice")


def bucket_counts(keys: DataFrame, by: str, width: int, lags_h: Sequence[int] = (0,)) -> DataFrame:
    """(by, _bucket, n): rows of ``keys`` (by, _key) a bucket, with a copy of every row moved on by each lag.

    Rows are counted by a unit that divides the hour and the bucket, and only the counts are moved.
    """
    unit = gcd(width, _HOUR)
    units = keys.groupBy(by, F.floor(F.col("_key") / F.lit(unit)).alias("_unit")).agg(F.count(F.lit(1)).alias("n"))
    moved = units.select(by, "n", F.explode(F.array(*[F.lit(int(h) * (_HOUR // unit)) for h in lags_h])).alias("_on"), "_unit")
    return (moved.groupBy(by, F.floor((F.col("_unit") + F.col("_on")) / F.lit(width // unit)).alias("_bucket"))
            .agg(F.sum("n").alias("n")))


def hot_cuts(keys: DataFrame, by: str, width: int, most: int, counts: DataFrame | None = None) -> DataFrame | None:
    """(by, _bucket, _slice, _part) of the buckets with more than ``most`` rows of ``keys`` (by, _key), or None.

    Counts are aggregates with partial results; a bucket's slices are at most SLICES rows. ``counts`` (by, _bucket, n)
    are counts of ``keys`` that are cheaper than their rows; a bucket may have several.
    """
    placed = keys.select(by, "_key", _bucket(width))
    counts = bucket_counts(keys, by, width) if counts is None else counts
    hot = counts.groupBy(by, "_bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select(by, "_bucket")
    if hot.isEmpty():
        return None
    slices = (placed.join(hot, [by, "_bucket"], "left_semi").groupBy(by, "_bucket", _slice(width))
              .agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy(by, "_bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).cast("int")
    cuts = checkpoint(slices.select(by, "_bucket", "_slice", part.alias("_part")).filter("_part > 0"))
    return F.broadcast(cuts) if cuts.count() <= CUTS_SENT else cuts


def _answer(left: DataFrame, at_time: str, obs: DataFrame, by: str, obs_time: str,
            obs_id: str, payload: Sequence[str], sign: int, bucket_seconds: int,
            lags_h: Sequence[int] = (0,), ahead: bool = False) -> DataFrame:
    """Distinct (by, at_time) of ``left`` with one struct column ``match_<lag>`` a lag.

    With ``ahead`` also ``next``, the first observation after the probe, from the same parts.
    """
    width = bucket_seconds * 1_000_000
    times = left.select(by, at_time).filter(F.col(at_time).isNotNull())
    probe_key = (F.unix_micros(at_time) * sign).alias("_key")
    probes = times.distinct().select(by, at_time, probe_key)
    lags = F.explode(F.array(*[F.lit(int(h)) for h in lags_h])).alias("_lag")
    seen = obs.filter(F.col(obs_time).isNotNull())
    time_key = F.unix_micros(F.col(obs_time)) * sign
    moved = seen.select(by, time_key.alias("_key"))
    if any(lags_h):
        moved = moved.select(by, "_key", lags).select(by, (F.col("_key") + F.col("_lag") * _HOUR).alias("_key"))
    keys = times.select(by, probe_key)
    counts = bucket_counts(seen.select(by, time_key.alias("_key")), by, width, lags_h).unionByName(bucket_counts(keys, by, width))
    cuts = hot_cuts(moved.unionByName(keys), by, width, SPLIT_ROWS, counts)

    def in_parts(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_bucket", _bucket(width))
        if cuts is None:
            return rows.withColumn("_part", F.lit(0))
        return (rows.withColumn("_slice", _slice(width)).join(cuts, [by, "_bucket", "_slice"], "left")
                .withColumn("_part", F.coalesce("_part", F.lit(0))).drop("_slice"))

    distinct_obs = (seen.select(by, time_key.alias("_key"), F.col(obs_id).alias("_id"),
                                F.struct(F.col(obs_time).alias("matched_at"), *payload).alias("_row"))
                    .groupBy(by, "_key").agg(F.max_by("_row", "_id").alias("_row")))
    sent = in_parts(distinct_obs.select(by, "_key", "_row", lags).withColumn("_key", F.col("_key") + F.col("_lag") * _HOUR))
    asked = in_parts(probes)

    end = F.struct("_key", "_row")
    part_ends = sent.groupBy(by, "_lag", "_bucket", "_part").agg(
        F.max_by(end, "_key").alias("_last"), *([F.min_by(end, "_key").alias("_first")] if ahead else []))
    ends = [c for c in part_ends.columns if c in ("_last", "_first")]
    nothing = F.lit(None).cast(part_ends.schema["_last"].dataType)
    # One row per station, lag and part: bounded by the calendar and by rows / SPLIT_ROWS. A part that is asked
    # for stands before its own ends in either order, so it sees those of other parts only.
    of = Window.partitionBy(by, "_lag")
    upto_here = lambda *order: of.orderBy(*order, F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = upto_here("_bucket", "_part"), upto_here(F.desc("_bucket"), F.desc("_part"))
    place = [by, "_lag", "_bucket", "_part"]
    seeded = (
        part_ends.select(*place, *ends, F.lit(False).alias("_asked"))
        .unionByName(asked.select(by, "_bucket", "_part").distinct().select(by, lags, "_bucket", "_part").select(
            *place, *[nothing.alias(c) for c in ends], F.lit(True).alias("_asked")))
        .withColumns({c: F.last(c, ignorenulls=True).over(before if c == "_last" else after) for c in ends})
        .filter("_asked")
    )
    seeds = (seeded.select(*place, F.explode(F.array_distinct(F.array(*ends))).alias("_seed"))
             .filter(F.col("_seed").isNotNull())
             .select(*place, F.col("_seed._key").alias("_key"), F.col("_seed._row").alias("_row")))

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    at = [by, "_bucket", "_part", "_key"]
    rows = (
        sent.unionByName(seeds).select(*at, F.lit(0).alias("_side"), "_lag", "_row", none(probes, at_time))
        .unionByName(asked.select(*at, F.lit(1).alias("_side"), none(sent, "_lag"), none(sent, "_row"), at_time))
    )
    one_part = Window.partitionBy(by, "_bucket", "_part")
    upto = one_part.orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {f"match_{h}": F.last(F.when(F.col("_lag") == h, F.col("_row")), ignorenulls=True).over(upto) for h in lags_h}
    if ahead:  # the same rows from the other end, so that a frame never reaches ahead
        later = one_part.orderBy(F.desc("_key"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found["next"] = F.last("_row", ignorenulls=True).over(later)
    return rows.withColumns(found).filter(F.col("_side") == 1).select(by, at_time, *found)


def asof_keys(left: DataFrame, obs: DataFrame, probe_time: str, payload: Sequence[str], *,
              by: str = "icao", obs_time: str = "observed_at", obs_id: str = "obs_id",
              direction: str = "backward", into: str = "match",
              bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Distinct (by, probe_time) of ``left`` with the struct ``into`` of its match."""
    sign = {"backward": 1, "forward": -1}[direction]
    answers = _answer(left, probe_time, obs, by, obs_time, obs_id, payload, sign, bucket_seconds)
    return answers.withColumnRenamed("match_0", into)


def asof_join(left: DataFrame, obs: DataFrame, probe_time: str, payload: Sequence[str], *,
              by: str = "icao", into: str = "match", **options) -> DataFrame:
    """``left`` plus a struct ``into`` holding the latest observation at or before
    ``probe_time`` (with direction="forward" the first at or after it), NULL where
    there is none. At one observation time the row with the largest id counts.
    """
    answers = asof_keys(left, obs, probe_time, payload, by=by, into=into, **options)
    return left.join(answers, [by, probe_time], "left")


def asof_sides(left: DataFrame, obs: DataFrame, probe_time: str, payload: Sequence[str], *, by: str = "icao",
               obs_time: str = "observed_at", obs_id: str = "obs_id", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``left`` plus ``match``, the latest observation at or before ``probe_time``, and ``next``, the first one after it."""
    answers = _answer(left, probe_time, obs, by, obs_time, obs_id, payload, 1, bucket_seconds, ahead=True)
    return left.join(answers.withColumnRenamed("match_0", "match"), [by, probe_time], "left")


def asof_lags(left: DataFrame, obs: DataFrame, t0: str, lags_h: Sequence[int], payload: Sequence[str],
              *, by: str = "icao", obs_time: str = "observed_at", obs_id: str = "obs_id",
              bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Distinct (by, t0) of ``left`` with one struct column ``lag_<h>`` per lag.

    All lags are answered by one pass over one row an issue time.
    Join the result to the rows that need it on (by, t0).
    """
    answers = _answer(left, t0, obs, by, obs_time, obs_id, payload, 1, bucket_seconds, lags_h)
    return answers.withColumnsRenamed({f"match_{h}": f"lag_{h}" for h in lags_h})


def latest_per_key(df: DataFrame, by: Sequence[str], time: str, tie: str) -> DataFrame:
    """The last row of every key: an aggregate with partial results, no sort window."""
    row = F.struct(*[c for c in df.columns if c not in by])
    last = df.groupBy(*by).agg(F.max_by(row, F.struct(time, tie)).alias("_r"))
    return last.select(*by, "_r.*")
