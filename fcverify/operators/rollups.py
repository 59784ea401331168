"""Skill tables over scored hours. Every one is a group-by with mergeable parts,
so a station holding most of the rows is reduced before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.functions.conditions import is_adverse
from fcverify.functions.timetokens import lead_bucket
from fcverify.operators.features import time_window
from fcverify.operators.forecasters import Forecaster, official
from fcverify.operators.verification import score_own_window
from fcverify.schema import LEADS_H, OFFICIAL_PROFILE


def observed_event() -> Column:
    return is_adverse(F.col("obs_category")).cast("int")


def contingency(scored: DataFrame, *by: str) -> DataFrame:
    """Contingency counts and skill ratios, per group or pooled."""
    return scored.groupBy(*by).agg(*S.outcome_counts()).withColumns(S.skill_ratios())


def station_summary(scored: DataFrame, profile: str = OFFICIAL_PROFILE) -> DataFrame:
    return contingency(scored.filter(F.col("scoring_profile") == profile), "icao")


def element_errors(scored: DataFrame, *by: str) -> DataFrame:
    """Rounded mean absolute element errors and the mean weighted score."""
    mean_abs = lambda c, digits: F.round(F.avg(F.abs(c)), digits)
    return scored.groupBy(*by).agg(
        mean_abs("vis_err_m", 0).alias("vis_mae_m"),
        mean_abs("ceiling_err_ft", 0).alias("ceiling_mae_ft"),
        mean_abs("wind_err_kt", 1).alias("wind_mae_kt"),
        mean_abs("dir_err_deg", 1).alias("dir_mae_deg"),
        F.round(F.avg("weighted_score"), 3).alias("mean_weighted_score"),
    )


def lead_curve(scored: DataFrame, *by: str) -> DataFrame:
    """Mean weighted score per 6 h lead bucket of non-negative leads."""
    return (scored.filter(F.col("lead_time_h") >= 0)
            .groupBy(*by, lead_bucket(F.col("lead_time_h")).alias("lead_bucket"))
            .agg(F.round(F.avg("weighted_score"), 3).alias("mean_score"),
                 F.count(F.lit(1)).alias("n")))


def probability_scores(p: str = "fcst_prob", event: Column | None = None) -> list[Column]:
    event = observed_event() if event is None else event
    return [S.brier(F.col(p), event).alias("brier"), S.brier_skill(F.col(p), event).alias("bss")]


def comparison(scored: DataFrame, *by: str) -> DataFrame:
    """Forecasters side by side: weighted score, Brier, BSS and skill ratios."""
    name = F.when(F.col("scoring_profile") == OFFICIAL_PROFILE, "official").otherwise(
        F.col("scoring_profile")).alias("profile")
    return (scored.groupBy(*by, name)
            .agg(F.avg("weighted_score").alias("mean_weighted_score"), *probability_scores(),
                 *S.outcome_counts())
            .withColumns(S.skill_ratios()))


def ranked_comparison(scored: DataFrame, *by: str) -> DataFrame:
    """Comparison with the rank by BSS, a missing BSS counting as -1."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("bss", F.lit(-1.0)).desc(), "profile")
    return comparison(scored, *by).withColumn("rank", F.row_number().over(order))


def evaluation(scored: DataFrame, forecasts_scored: int | Column | None = None) -> DataFrame:
    """Pooled metrics (``level`` 1) and the same per lead bucket (``level`` 0; an unknown lead is a bucket of its own).

    ROLLUP gives both from one shuffle.
    """
    mean_abs = lambda c: F.avg(F.abs(c))
    keyed = scored.withColumn("lead_bucket", lead_bucket(F.col("lead_time_h")))
    table = (keyed.rollup("lead_bucket")
             .agg(F.grouping("lead_bucket").cast("int").alias("level"),
                  F.avg("weighted_score").alias("mean_weighted"),
                  mean_abs("vis_err_m").alias("vis_mae"),
                  mean_abs("ceiling_err_ft").alias("ceiling_mae"),
                  mean_abs("wind_err_kt").alias("wind_mae"),
                  *S.outcome_counts())
             .withColumns(S.skill_ratios()))
    if forecasts_scored is not None:
        n = F.lit(forecasts_scored) if isinstance(forecasts_scored, int) else forecasts_scored
        table = table.withColumn("n_tafs", n)
    return table


def evaluate_forecaster(forecasts: DataFrame, obs: DataFrame, groups: DataFrame, forecaster: Forecaster = official,
                        start=None, end=None) -> DataFrame:
    """``evaluation`` of one forecaster over the forecasts issued in a window, each against the observations of its own
    validity. ``n_tafs`` counts the forecasts that gave at least one scored hour."""
    scored = score_own_window(time_window(forecasts, "issued_at", start, end), obs, groups, forecaster)
    return evaluation(scored, scored.agg(F.countDistinct("taf_id")).scalar())


def official_skill(scored: DataFrame, since: str, profile: str = OFFICIAL_PROFILE) -> DataFrame:
    """Pooled BSS of one profile on and after a date."""
    window = ((F.col("scoring_profile") == profile)
              & (F.col("valid_hour") >= F.lit(since).cast("timestamp")))
    return scored.filter(window).agg(F.count(F.lit(1)).alias("n"), *probability_scores())


RELIABILITY_EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.01)


def reliability(df: DataFrame, p: str = "p", event: str = "event") -> DataFrame:
    """Forecast probability against observed frequency in fixed bins."""
    value = F.col(p)
    number = None
    for i in range(len(RELIABILITY_EDGES) - 1):
        hit = (value >= RELIABILITY_EDGES[i]) & (value < RELIABILITY_EDGES[i + 1])
        number = F.when(hit, F.lit(i)) if number is None else number.when(hit, F.lit(i))
    return (df.withColumn("bin", number).filter(F.col("bin").isNotNull())
            .groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"),
                 F.avg(F.col(event).cast("double")).alias("obs_freq")))


def skill_by(df: DataFrame, key: str, p: str = "p", event: str = "event",
             need_events: bool = False) -> DataFrame:
    """BSS, number of rows and event rate per key."""
    rate = F.avg(F.col(event).cast("double"))
    out = df.groupBy(key).agg(S.brier_skill(F.col(p), F.col(event)).alias("bss"),
                              F.count(F.lit(1)).alias("n"), rate.alias("rate"))
    return out.filter(F.col("rate") > 0) if need_events else out


def skill_by_lead(df: DataFrame, lead: str = "lead_h") -> DataFrame:
    return skill_by(df.filter(F.col(lead).isin(*LEADS_H)), lead)


def skill_by_region(df: DataFrame) -> DataFrame:
    return skill_by(df, "region", need_events=True)


def skill_rollup(scored: DataFrame, stations: DataFrame) -> DataFrame:
    """Region, station, month and lead bucket subtotals of skill in one pass.

    The level tells subtotal rows apart: 0 is the finest, 15 the grand total.
    """
    keyed = (scored.join(stations.select("icao", "region"), "icao")
             .withColumn("month", F.date_format("valid_hour", "yyyy-MM"))
             .withColumn("lead_bucket", lead_bucket(F.col("lead_time_h"))))
    return (keyed.rollup("region", "icao", "month", "lead_bucket")
            .agg(F.grouping_id().cast("int").alias("level"), *probability_scores(), *S.outcome_counts())
            .withColumns(S.skill_ratios()))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the stored tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def masked_moments(df: DataFrame, columns: Sequence[str], mask: Column) -> DataFrame:
    """Mean and population deviation of every target over masked rows, deviation 0 as 1."""
    parts = []
    for c in columns:
        value = F.when(mask, F.col(c))
        spread = F.stddev_pop(value)
        parts += [F.avg(value).alias(f"{c}_mean"),
                  F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*parts)


def class_weights(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """total / (k * max(count, 1)) for every class, also for classes without rows."""
    k = len(classes)
    total = F.count_if(F.col(label).isin(*classes)).cast("double")
    row = df.agg(*[
        F.struct(F.lit(c).alias(label), F.count_if(F.col(label) == c).alias("n"),
                 (total / (F.lit(k) * F.greatest(F.count_if(F.col(label) == c), F.lit(1)))).alias("weight")
                 ).alias(f"c{i}") for i, c in enumerate(classes)])
    return row.select(F.inline(F.array(*[f"c{i}" for i in range(k)])))


def pinball_loss(df: DataFrame, target: str, predictions: dict[float, str], mask: Column) -> DataFrame:
    """Mean quantile loss over masked rows, summed over the quantiles."""
    total = None
    for q, column in predictions.items():
        err = F.col(target) - F.col(column)
        part = F.greatest(err * q, err * (q - 1))
        total = part if total is None else total + part
    weight = mask.cast("double")
    return df.agg((F.sum(total * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("pinball"))
