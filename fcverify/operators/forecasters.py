"""Forecasters: (forecasts, observations) to expected hours.

Every forecaster returns the forecast's columns plus valid_hour, prevailing,
tempo, prob and, where it states its own probability, fcst_prob. A further one
is added by registering a function with the same signature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.conditions import category_of_rank, category_rank, flight_category, is_adverse, state
from fcverify.operators.asof import asof_join, asof_sides
from fcverify.operators.barrier import once
from fcverify.operators.expand import expand, hour_grid, only_prevailing
from fcverify.operators.quantiles import group_median, group_mode
from fcverify.schema import ALIGN_TOLERANCE_S, ELEMENTS

STATE_COLUMNS = (*ELEMENTS, "flight_category")


def hour_climatology(obs: DataFrame) -> DataFrame:
    """(icao, hod): median visibility and ceiling, modal category, adverse share.

    The share averages known categories only; without any, the category follows
    from the medians and the share is 0.
    """
    keyed = obs.withColumn("hod", F.hour("observed_at"))
    keys = ["icao", "hod"]
    known = F.col("flight_category").isNotNull()
    share = keyed.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(known, is_adverse(F.col("flight_category")).cast("double"))),
                   F.lit(0.0)).alias("p_adverse"))
    vis = group_median(keyed, keys, "vis_m", F.floor(F.col("vis_m") / 100), "vis_m")
    ceil = group_median(keyed, keys, "ceiling_ft", F.floor(F.col("ceiling_ft") / 500), "ceiling_ft")
    # a category is a long expression where it is derived, and its rank reads it several times
    mode = group_mode(once(keyed.select(*keys, "flight_category")), keys, category_rank(F.col("flight_category")), "mode_rank")
    return (
        share.join(vis, keys, "left").join(ceil, keys, "left").join(mode, keys, "left")
        .select(*keys, "vis_m", "ceiling_ft",
                F.coalesce(category_of_rank(F.col("mode_rank")),
                           flight_category(F.col("ceiling_ft"), F.col("vis_m"))).alias("flight_category"),
                "p_adverse")
    )


def issue_anchor(forecasts: DataFrame, obs: DataFrame, look_ahead: bool) -> DataFrame:
    """Forecasts plus ``anchor``, the observation a persistence forecast repeats.

    Causal form: the latest at or before issue. With ``look_ahead`` the nearest
    within the tolerance on either side comes first, as in bulk scoring.
    """
    payload = [*STATE_COLUMNS]
    if not look_ahead:
        return asof_join(forecasts, obs, "issued_at", payload, into="anchor")
    found = asof_sides(forecasts, obs, "issued_at", payload).withColumnsRenamed({"match": "anchor", "next": "_next"})
    gap = lambda s: F.abs(F.unix_micros(F.col(s)["matched_at"]) - F.unix_micros("issued_at"))
    nearer = F.col("anchor").isNull() | (gap("_next") <= gap("anchor"))
    use_next = (gap("_next") <= ALIGN_TOLERANCE_S * 1_000_000) & nearer
    return found.withColumn("anchor", F.when(use_next, F.col("_next")).otherwise(F.col("anchor"))).drop("_next")


def _null_state() -> Column:
    return state(**{c: F.lit(None) for c in STATE_COLUMNS})


def _filled(source: Column) -> Column:
    """State of an anchor, all NULL without one, category derived if not reported."""
    derived = F.coalesce(source["flight_category"],
                         flight_category(source["ceiling_ft"], source["vis_m"]))
    return state(source, flight_category=derived)


def official(forecasts: DataFrame, obs: DataFrame, groups: DataFrame) -> DataFrame:
    """The issued forecast itself, expanded from its change groups."""
    return expand(forecasts, groups)


def official_at(requests: DataFrame, forecasts: DataFrame, groups: DataFrame) -> DataFrame:
    """The issued forecast for requested (icao, issued_at, valid_from, valid_to).

    The groups are those of the forecast stored for that station and issue time,
    the hours are those of the request; a request without a forecast has no rows.
    """
    ids = forecasts.select("icao", "issued_at", "taf_id")
    return expand(requests.join(ids, ["icao", "issued_at"]), groups)


def persistence_bulk(forecasts: DataFrame, obs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Repeat the observation nearest to issue; no observation so far, no hours."""
    anchored = issue_anchor(forecasts, obs, look_ahead=True).filter(F.col("anchor").isNotNull())
    return only_prevailing(hour_grid(anchored), state(F.col("anchor"))).drop("anchor")


def persistence(forecasts: DataFrame, obs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Repeat the latest observation up to issue; without one the state is unknown."""
    anchored = issue_anchor(forecasts, obs, look_ahead=False)
    return only_prevailing(hour_grid(anchored), _filled(F.col("anchor"))).drop("anchor")


def _with_climatology(forecasts: DataFrame, obs: DataFrame) -> DataFrame:
    clim = hour_climatology(obs).select("icao", F.col("hod").alias("_hod"), F.struct(
        F.lit(None).cast("double").alias("wind_dir_deg"),
        F.lit(None).cast("double").alias("wind_spd_kt"),
        F.lit(None).cast("double").alias("wind_gust_kt"),
        "vis_m", "ceiling_ft", "flight_category").alias("_clim"), "p_adverse")
    hours = hour_grid(forecasts).withColumn("_hod", F.hour("valid_hour"))
    return hours.join(clim, ["icao", "_hod"], "left").drop("_hod")


def climatology_bulk(forecasts: DataFrame, obs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Hour-of-day climate with its adverse share as probability, 0 if unseen."""
    hours = _with_climatology(forecasts, obs)
    return (only_prevailing(hours, state(F.col("_clim")))
            .withColumn("fcst_prob", F.coalesce("p_adverse", F.lit(0.0)))
            .drop("_clim", "p_adverse"))


def climatology(forecasts: DataFrame, obs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Hour-of-day climate as a plain state, the probability follows from it."""
    hours = _with_climatology(forecasts, obs)
    return only_prevailing(hours, _filled(F.col("_clim"))).drop("_clim", "p_adverse")


Forecaster = Callable[..., DataFrame]

# Profiles of bulk scoring and the candidates of the comparison run.
BULK_PROFILES: dict[str, Forecaster] = {
    "categorical": official,
    "persistence": persistence_bulk,
    "climatology": climatology_bulk,
}
CANDIDATES: dict[str, Forecaster] = {"persistence": persistence, "climatology": climatology}
