"""Read-side queries over the stored tables, one function per view a client needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.conditions import category_rank
from fcverify.operators import rollups as R
from fcverify.operators.asof import latest_per_key
from fcverify.operators.expand import nest_groups
from fcverify.operators.features import time_window
from fcverify.schema import OFFICIAL_PROFILE

DEFAULT_DAYS = 7


def _recent(df: DataFrame, time: str, start, end) -> DataFrame:
    """Half-open window on ``time``; the last seven days up to now by default."""
    if end is None:
        df = df.filter(F.col(time) < F.current_timestamp())
    if start is None:
        df = df.filter(F.col(time) >= F.current_timestamp() - F.make_dt_interval(F.lit(DEFAULT_DAYS)))
    return time_window(df, time, start, end)


def _station(df: DataFrame, icao: str | None) -> DataFrame:
    return df if icao is None else df.filter(F.col("icao") == icao.upper())


def stations_latest(stations: DataFrame, obs: DataFrame) -> DataFrame:
    """Every station with its latest observed category, by region and code."""
    last = latest_per_key(obs.select("icao", "observed_at", "obs_id", "flight_category"),
                          ["icao"], "observed_at", "obs_id")
    return (stations.join(last.select("icao", "observed_at", "flight_category"), "icao", "left")
            .orderBy("region", "icao"))


def station(stations: DataFrame, icao: str) -> DataFrame:
    return _station(stations, icao)


def observation_series(obs: DataFrame, icao: str | None = None, start=None, end=None) -> DataFrame:
    return _recent(_station(obs, icao), "observed_at", start, end).orderBy("icao", "observed_at")


def forecasts_with_groups(forecasts: DataFrame, groups: DataFrame, icao: str | None = None,
                          start=None, end=None) -> DataFrame:
    """Forecasts issued in the window with their change groups ordered by start.

    Only the groups of selected forecasts are aggregated.
    """
    chosen = _recent(_station(forecasts, icao), "issued_at", start, end)
    nested = nest_groups(groups.join(chosen.select("taf_id"), "taf_id", "left_semi"))
    by_start = F.transform(
        F.array_sort(F.transform("groups", lambda g: F.struct(g["valid_from"].alias("at"),
                                                              g["group_seq"].alias("seq"), g.alias("g")))),
        lambda r: r["g"])
    nested = nested.select("taf_id", by_start.alias("groups"))
    out = chosen.join(nested, "taf_id", "left")
    none = F.array().cast(nested.schema["groups"].dataType)
    return out.withColumn("groups", F.coalesce("groups", none)).orderBy("issued_at")


def nwp_series(nwp: DataFrame, icao: str | None = None, start=None, end=None) -> DataFrame:
    return _recent(_station(nwp, icao), "valid_time", start, end).orderBy("icao", "valid_time")


def summary(scored: DataFrame) -> DataFrame:
    return R.station_summary(scored).orderBy("icao")


def scorecard(scored: DataFrame, icao: str | None = None, profile: str = OFFICIAL_PROFILE) -> dict[str, DataFrame]:
    """Skill, element errors and lead curve of one station, or of each."""
    rows = _station(scored, icao).filter(F.col("scoring_profile") == profile)
    return {"skill": R.contingency(rows, "icao"), "errors": R.element_errors(rows, "icao"),
            "lead_curve": R.lead_curve(rows, "icao").orderBy("icao", "lead_bucket")}


def comparison(scored: DataFrame, icao: str | None = None) -> DataFrame:
    return R.ranked_comparison(_station(scored, icao), "icao").orderBy("icao", "rank")


def verification_rows(scored: DataFrame, icao: str | None = None, profile: str | None = None) -> DataFrame:
    """Scored hours in time order; all profiles unless one is asked for."""
    rows = _station(scored, icao)
    if profile is not None:
        rows = rows.filter(F.col("scoring_profile") == profile)
    return rows.select("icao", "valid_hour", "lead_time_h", "fcst_category", "obs_category", "category_outcome",
                       "wind_err_kt", "vis_err_m", "ceiling_err_ft", "weighted_score").orderBy("icao", "valid_hour")


def prevailing_step_series(forecasts: DataFrame, groups: DataFrame) -> DataFrame:
    """Category rank over time from the base and FM groups, for a step chart."""
    steps = groups.filter(F.col("group_type").isin("BASE", "FM") & F.col("flight_category").isNotNull())
    rank: Column = category_rank(F.col("flight_category"))
    return (steps.select("taf_id", "valid_from", rank.alias("category_rank"))
            .join(forecasts.select("taf_id", "icao"), "taf_id").orderBy("icao", "valid_from"))
