"""Scoring of expected hours against observations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.functions.conditions import is_adverse
from fcverify.functions.timetokens import lead_hours
from fcverify.operators.forecasters import BULK_PROFILES, CANDIDATES, Forecaster, official
from fcverify.operators.nearest import align_hours, align_hours_within
from fcverify.schema import ALIGN_TOLERANCE_S, OFFICIAL_PROFILE, VERIFICATION_COLUMNS

OBSERVED = ("wind_dir_deg", "wind_spd_kt", "vis_m", "ceiling_ft", "flight_category")


def score_hours(aligned: DataFrame, profile: str | Column = OFFICIAL_PROFILE) -> DataFrame:
    """Verification rows from expected hours that carry their observation ``obs``."""
    prevailing, tempo, prob, obs = (F.col(c) for c in ("prevailing", "tempo", "prob", "obs"))
    seen = obs["flight_category"]
    difference = lambda e: (prevailing[e] - obs[e]).cast("double")
    stated = S.adverse_probability(prevailing, tempo, prob)
    if "fcst_prob" in aligned.columns:  # NULL: this forecaster states none
        stated = F.coalesce("fcst_prob", stated)
    columns = {
        "taf_id": F.col("taf_id"),
        "icao": F.col("icao"),
        "valid_hour": F.col("valid_hour"),
        "lead_time_h": lead_hours(F.col("valid_hour"), F.col("issued_at")),
        "scoring_profile": F.lit(profile) if isinstance(profile, str) else profile,
        "fcst_category": prevailing["flight_category"],
        "obs_category": seen,
        "category_outcome": S.outcome(S.warned(prevailing, tempo, prob), is_adverse(seen)),
        "fcst_prob": stated,
        "wind_err_kt": difference("wind_spd_kt"),
        "dir_err_deg": S.angular_difference(prevailing["wind_dir_deg"], obs["wind_dir_deg"]).cast("double"),
        "temp_err_c": F.lit(None).cast("double"),
        "vis_err_m": difference("vis_m"),
        "ceiling_err_ft": difference("ceiling_ft"),
        "weighted_score": S.weighted_score(prevailing, tempo, prob, seen),
    }
    return (aligned.filter(obs.isNotNull())
            .select(*[columns[c].alias(c) for c in VERIFICATION_COLUMNS]))


def verifiable(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter(F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull())


def pending(forecasts: DataFrame, scored: DataFrame | None, profile: str | None = None) -> DataFrame:
    """Verifiable forecasts without a scored hour, under one profile or under any."""
    ready = verifiable(forecasts)
    if scored is None:
        return ready
    done = scored if profile is None else scored.filter(F.col("scoring_profile") == profile)
    # the history's ids look small beside its rows to the planner, so that it would broadcast them
    return ready.join(done.select("taf_id").hint("merge"), "taf_id", "left_anti")


def score_profile(forecasts: DataFrame, obs: DataFrame, groups: DataFrame, profile: str,
                  scored: DataFrame | None = None,
                  forecasters: Mapping[str, Forecaster] = BULK_PROFILES, near: DataFrame | None = None) -> DataFrame:
    """Bulk scoring: all pending forecasts of all stations in one plan.

    ``near`` are the observations that the hours are held against, where the caller
    knows that fewer than ``obs`` can be; a forecaster may look back over all of those.
    """
    hours = forecasters[profile](pending(forecasts, scored, profile), obs, groups)
    return score_hours(align_hours(hours, obs if near is None else near, OBSERVED), profile)


def observed_near(obs: DataFrame, forecasts: DataFrame) -> DataFrame | None:
    """Observations that can be nearest to an hour of the forecasts; None without forecasts.

    Two times leave the forecasts, so stored observations are pruned before they are read, by day where they
    are kept by the ``day`` of their time.
    """
    span = forecasts.agg(F.min("valid_from").alias("a"), F.max("valid_to").alias("b")).first()
    if span["a"] is None or span["b"] is None:
        return None
    reach = F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(float(ALIGN_TOLERANCE_S)))
    first, last = F.lit(span["a"]) - reach, F.lit(span["b"]) + reach
    if "day" in obs.columns:
        obs = obs.filter(F.col("day").between(F.to_date(first), F.to_date(last)))
    return obs.filter(F.col("observed_at").between(first, last))


def score_profiles(forecasts: DataFrame, obs: DataFrame, groups: DataFrame,
                   profiles: Iterable[str] = tuple(BULK_PROFILES), scored: DataFrame | None = None,
                   forecasters: Mapping[str, Forecaster] = BULK_PROFILES) -> DataFrame:
    """Verification rows of several profiles as one fact table.

    The expected hours of all profiles meet the observations together: these are
    reduced to whole hours once, and every hour is aligned and scored in one pass.
    """
    parts = []
    for p in profiles:
        hours = forecasters[p](pending(forecasts, scored, p), obs, groups)
        own = F.col("fcst_prob") if "fcst_prob" in hours.columns else F.lit(None)
        parts.append(hours.select("taf_id", "icao", "issued_at", "valid_hour", "prevailing", "tempo", "prob",
                                  own.cast("double").alias("fcst_prob"), F.lit(p).alias("_profile")))
    return score_hours(align_hours(reduce(DataFrame.unionByName, parts), obs, OBSERVED), F.col("_profile"))


def score_own_window(forecasts: DataFrame, obs: DataFrame, groups: DataFrame,
                     forecaster: Forecaster = official, profile: str = OFFICIAL_PROFILE,
                     lower: str = "first_hour") -> DataFrame:
    """Score each forecast against the observations of its own validity only."""
    hours = forecaster(verifiable(forecasts), obs, groups)
    return score_hours(align_hours_within(hours, obs, OBSERVED, lower=lower), profile)


def run_candidates(forecasts: DataFrame, obs: DataFrame, groups: DataFrame,
                   scored: DataFrame | None = None,
                   candidates: Mapping[str, Forecaster] = CANDIDATES) -> DataFrame:
    """Every candidate forecaster against every forecast it has not been scored on.

    The hours of all candidates meet the observations of their own windows together.
    """
    parts = [forecaster(verifiable(pending(forecasts, scored, name)), obs, groups)
             .select("taf_id", "icao", "issued_at", "valid_from", "valid_to", "valid_hour", "prevailing", "tempo", "prob", F.lit(name).alias("_profile"))
             for name, forecaster in candidates.items()]
    hours = reduce(DataFrame.unionByName, parts)
    return score_hours(align_hours_within(hours, obs, OBSERVED), F.col("_profile"))


def rows_per_profile(scored: DataFrame) -> DataFrame:
    return scored.groupBy("scoring_profile").agg(F.count(F.lit(1)).alias("rows_written"))
