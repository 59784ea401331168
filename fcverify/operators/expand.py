"""Hourly expected states from forecast change groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.conditions import flight_category, state
from fcverify.functions.timetokens import validity_hours
from fcverify.schema import ELEMENTS, PROB_STATE, STATE

_GROUP_FIELDS = ("group_seq", "group_type", "probability", "valid_from", "valid_to",
                 *ELEMENTS, "flight_category")


def hour_grid(forecasts: DataFrame) -> DataFrame:
    """One row per forecast and whole hour of its validity."""
    return forecasts.withColumn("valid_hour", F.explode(validity_hours(F.col("valid_from"),
                                                                       F.col("valid_to"))))


def nest_groups(groups: DataFrame, key: str = "taf_id") -> DataFrame:
    """(key, groups): the change groups of a forecast in message order.

    A message has a handful of groups; collecting them as a set lets map-side
    aggregation drop repeated copies, so the array stays that short.
    """
    rows = groups.groupBy(key).agg(F.collect_set(F.struct(*_GROUP_FIELDS)).alias("groups"))
    return rows.withColumn("groups", F.array_sort("groups"))


def _recomputed(s: Column) -> Column:
    return F.struct(*[s[e].alias(e) for e in ELEMENTS],
                    flight_category(s["ceiling_ft"], s["vis_m"]).alias("flight_category"))


def prevailing_steps(groups: Column) -> Column:
    """array<struct<eff, state>>: the prevailing state from each change on.

    Entry 0 is the base state with no time. FM takes over everything at its start;
    BECMG overrides the elements it names, at its end. The fold runs once per
    forecast, the hours only look their step up.
    """
    base = F.try_element_at(F.filter(groups, lambda g: g["group_type"] == "BASE"), F.lit(1))
    changes = F.array_sort(F.transform(
        F.filter(groups, lambda g: g["group_type"].isin("FM", "BECMG")),
        lambda g: F.struct(
            F.when(g["group_type"] == "FM", g["valid_from"]).otherwise(g["valid_to"]).alias("eff"),
            g["group_seq"].alias("group_seq"),
            (g["group_type"] == "FM").alias("takes_over"),
            state(g).alias("state"),
        ),
    ))

    def apply(steps, change):
        last = F.element_at(steps, -1)["state"]
        merged = F.struct(*[
            F.when(change["takes_over"] | change["state"][e].isNotNull(), change["state"][e])
            .otherwise(last[e]).alias(e) for e in ELEMENTS
        ])
        return F.concat(steps, F.array(F.struct(change["eff"].alias("eff"),
                                                _recomputed(merged).alias("state"))))

    start = F.array(F.struct(F.lit(None).cast("timestamp").alias("eff"),
                             _recomputed(state(base)).alias("state")))
    return F.aggregate(changes, start, apply)


def _overlay_window(groups: Column, prefix: str) -> Column:
    return F.filter(groups, lambda g: g["group_type"].startswith(prefix))


def _active(overlays: Column, hour: Column) -> Column:
    """The last overlay in message order that covers the hour."""
    return F.try_element_at(
        F.filter(overlays, lambda g: (g["valid_from"] <= hour) & (hour < g["valid_to"])), F.lit(-1))


def expand_nested(forecasts: DataFrame) -> DataFrame:
    """Expected hours of forecasts that carry their change groups as an array.

    A narrow transformation: steps and overlays are prepared once per forecast,
    the hours are generated from the row, no shuffle takes place.
    """
    prepared = (
        forecasts
        .withColumn("_steps", prevailing_steps(F.col("groups")))
        .withColumn("_tempo", _overlay_window(F.col("groups"), "TEMPO"))
        .withColumn("_prob", _overlay_window(F.col("groups"), "PROB"))
        .drop("groups")
    )
    hour = F.col("valid_hour")
    tempo, prob = _active(F.col("_tempo"), hour), _active(F.col("_prob"), hour)
    step = F.element_at(F.filter("_steps", lambda s: s["eff"].isNull() | (s["eff"] <= hour)), -1)
    return (
        hour_grid(prepared)
        .withColumns({"_t": tempo, "_p": prob})
        .withColumns({
            "prevailing": step["state"],
            "tempo": F.when(F.col("_t").isNotNull(), state(F.col("_t"))),
            "prob": F.when(F.col("_p").isNotNull(), F.struct(
                *[F.col("_p")[e].cast("double").alias(e) for e in ELEMENTS],
                F.col("_p.flight_category").alias("flight_category"),
                F.col("_p.probability").cast("int").alias("probability"))),
        })
        .drop("_steps", "_tempo", "_prob", "_t", "_p")
    )


def expand(forecasts: DataFrame, groups: DataFrame) -> DataFrame:
    """Expected hours of a forecast table and its change group table."""
    nested = forecasts.join(nest_groups(groups), "taf_id", "left")
    empty = F.array().cast(nested.schema["groups"].dataType)
    return expand_nested(nested.withColumn("groups", F.coalesce("groups", empty)))


def only_prevailing(hours: DataFrame, prevailing: Column) -> DataFrame:
    """Expected hours of a forecaster that states one condition per hour."""
    return hours.withColumns({
        "prevailing": prevailing,
        "tempo": F.lit(None).cast(STATE),
        "prob": F.lit(None).cast(PROB_STATE),
    })
