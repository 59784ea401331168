"""Nearest observation to a whole hour within a tolerance.

Each observation is sent to the few whole hours it can serve and reduced there
with a mergeable aggregate. What is left is one row per station and hour, joined
by equality. No range join and no window is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.timetokens import hour_floor
from fcverify.operators.asof import asof_join
from fcverify.operators.barrier import once
from fcverify.schema import ALIGN_TOLERANCE_S


def _gap(struct: Column, hour: Column) -> Column:
    return F.abs(F.unix_micros(struct["observed_at"]) - F.unix_micros(hour))


def closer(before: Column, after: Column, hour: Column) -> Column:
    """The nearer of two candidates; the later one wins a tie."""
    return (
        F.when(after.isNull(), before)
        .when(before.isNull(), after)
        .when(_gap(before, hour) < _gap(after, hour), before)
        .otherwise(after)
    )


def hour_candidates(obs: DataFrame, payload: Sequence[str], *, by: str = "icao",
                    obs_id: str = "obs_id", tolerance_s: int = ALIGN_TOLERANCE_S) -> DataFrame:
    """(by, valid_hour, before, after): the closest observation on either side of
    every hour, within the tolerance. ``after`` includes the hour itself."""
    reach = tolerance_s // 3600
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 2)])
    time = F.col("observed_at")
    row = F.struct(time, F.col(obs_id).alias("obs_id"),
                   *[c for c in payload if c not in ("observed_at", "obs_id")])
    late = time >= F.col("valid_hour")
    return (
        obs.withColumn("_step", F.explode(steps))
        .withColumn("valid_hour", hour_floor(time) + F.make_dt_interval(F.lit(0), F.col("_step")))
        .filter(F.abs(F.unix_micros(time) - F.unix_micros("valid_hour")) <= tolerance_s * 1_000_000)
        .groupBy(by, "valid_hour")
        .agg(F.max_by(row, F.when(~late, F.struct(time, F.col(obs_id)))).alias("before"),
             F.min_by(row, F.when(late, F.struct(time, -F.col(obs_id)))).alias("after"))
    )


def nearest_by_hour(obs: DataFrame, payload: Sequence[str], *, by: str = "icao",
                    obs_id: str = "obs_id", tolerance_s: int = ALIGN_TOLERANCE_S) -> DataFrame:
    """(by, valid_hour, obs): the nearest observation of every hour that has one."""
    sides = hour_candidates(obs, payload, by=by, obs_id=obs_id, tolerance_s=tolerance_s)
    return sides.select(by, "valid_hour",
                        closer(F.col("before"), F.col("after"), F.col("valid_hour")).alias("obs"))


def align_hours(hours: DataFrame, obs: DataFrame, payload: Sequence[str], *, how: str = "inner",
                by: str = "icao", tolerance_s: int = ALIGN_TOLERANCE_S) -> DataFrame:
    """Hour rows with the nearest observation of their station as struct ``obs``."""
    best = nearest_by_hour(obs, payload, by=by, tolerance_s=tolerance_s)
    return hours.join(best, [by, "valid_hour"], how)


def align_hours_within(hours: DataFrame, obs: DataFrame, payload: Sequence[str], *,
                       lower: str = "first_hour", by: str = "icao",
                       tolerance_s: int = ALIGN_TOLERANCE_S) -> DataFrame:
    """As ``align_hours`` but only with observations of the forecast's own window.

    The window is [first hour, valid_to) or, with ``lower="valid_from"``,
    [valid_from, valid_to). Hours are one hour apart and the tolerance is below
    that, so the lower bound can only remove candidates of the first hour: there
    the ``before`` side falls away, and a start inside the hour needs the first
    observation from that start on. The upper bound only cuts the ``after`` side.
    """
    if tolerance_s >= 3600:
        raise ValueError("the window form needs a tolerance below one hour")
    sides = hour_candidates(obs, payload, by=by, tolerance_s=tolerance_s)
    first = F.col("valid_hour") == hour_floor(F.col("valid_from"))
    joined = hours.join(sides, [by, "valid_hour"], "left")
    after = F.col("after")
    if lower == "valid_from":
        # A whole-hour start is covered by ``after``; only other starts are probed,
        # and only once per station and start.
        inside = first & (F.col("valid_from") > F.col("valid_hour"))
        fields = [c for c in sides.schema["after"].dataType.names if c != "observed_at"]
        starts = hours.filter(inside).select(by, "valid_from").distinct()
        found = asof_join(starts, obs, "valid_from", fields, by=by, direction="forward", into="_m")
        found = found.select(by, "valid_from", F.struct(
            F.col("_m.matched_at").alias("observed_at"),
            *[F.col(f"_m.{f}").alias(f) for f in fields]).alias("_from"))
        joined = joined.join(found, [by, "valid_from"], "left")
        near = (F.unix_micros("_from.observed_at") - F.unix_micros("valid_hour")
                <= tolerance_s * 1_000_000)
        after = F.when(inside, F.when(near, F.col("_from"))).otherwise(after)
    before = F.when(~first, F.col("before"))
    after = F.when(after["observed_at"] < F.col("valid_to"), after)
    before = F.when(before["observed_at"] < F.col("valid_to"), before)
    # the choice is long; behind the barrier it is made once a row, not once for every field that is read of it
    chosen = joined.withColumns({"before": before, "after": after}).drop("_from")
    return (
        once(once(chosen).withColumn("obs", closer(F.col("before"), F.col("after"), F.col("valid_hour"))).drop("before", "after"))
        .filter(F.col("obs").isNotNull())
    )
