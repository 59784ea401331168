"""Promotion gate: challenger against champion on the same hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.functions.conditions import is_adverse
from fcverify.operators.bootstrap import HSS_REPLICATES, outcome_cells, with_interval
from fcverify.operators.expand import hour_grid
from fcverify.operators.features import request_features, time_window
from fcverify.operators.forecasters import Forecaster, official
from fcverify.operators.nearest import align_hours_within
from fcverify.operators.probgroups import hours_from_predictions
from fcverify.operators.verification import OBSERVED, score_hours, verifiable
from fcverify.plans.ladder import LadderModel
from fcverify.schema import GATE_END, GATE_START
from fcverify.sources import tables as T


def model_forecaster(model: LadderModel, nwp: DataFrame, stations: DataFrame) -> Forecaster:
    """A fitted ladder model as a forecaster: features of all hours in one plan."""

    def forecast(forecasts: DataFrame, obs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        hours = hour_grid(forecasts)
        asked = hours.select("icao", F.col("issued_at").alias("t0"), F.col("valid_hour").alias("valid_time")).distinct()
        predicted = hours_from_predictions(model.predict(request_features(asked, obs, nwp, stations)))
        states = predicted.select("icao", F.col("t0").alias("issued_at"), F.col("valid_time").alias("valid_hour"),
                                  "prevailing", "tempo", "prob")
        return hours.join(states, ["icao", "issued_at", "valid_hour"])

    return forecast


def score_in_window(forecasts: DataFrame, obs: DataFrame, groups: DataFrame, forecaster: Forecaster,
                    start=GATE_START, end=GATE_END, history: DataFrame | None = None) -> DataFrame:
    """Scored hours of the forecasts issued in the window, each against the window's
    observations within its own validity. ``history`` feeds the forecaster."""
    chosen = time_window(verifiable(forecasts), "issued_at", start, end)
    seen = time_window(obs, "observed_at", start, end)
    hours = forecaster(chosen, obs if history is None else history, groups)
    return score_hours(align_hours_within(hours, seen, OBSERVED, lower="valid_from"), "gate")


def pair(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """Hours that both forecasters verified, with both outcomes and probabilities."""
    side = lambda df, name: df.select("taf_id", "icao", "valid_hour", F.col("category_outcome").alias(name),
                                      F.col("fcst_prob").alias(f"p_{name}"))
    event = champion.select("taf_id", "icao", "valid_hour", "category_outcome", "fcst_prob",
                            is_adverse(F.col("obs_category")).cast("int").alias("event"))
    left = event.withColumnsRenamed({"category_outcome": "champion", "fcst_prob": "p_champion"})
    return left.join(side(challenger, "challenger"), ["taf_id", "icao", "valid_hour"])


def decide(paired: DataFrame, challenger: str, champion: str = "official", n_boot: int = HSS_REPLICATES,
           seed: int = 0) -> DataFrame:
    """One row: scores of both, HSS difference with interval, and whether to promote. The pairs are read once."""
    counted = paired.agg(outcome_cells().alias("cells"),
                         S.brier_skill(F.col("p_champion"), F.col("event")).alias("champion_bss"),
                         S.brier_skill(F.col("p_challenger"), F.col("event")).alias("challenger_bss"))
    return with_interval(counted, n_boot, seed).select(
        F.lit("promotion_gate").alias("kind"), F.lit(challenger).alias("challenger"), F.lit(champion).alias("champion"),
        F.col("n").alias("n_paired"), "champion_hss", "challenger_hss", "champion_bss", "challenger_bss",
        F.col("diff").alias("hss_diff"), "ci_low", "ci_high", F.col("wins").alias("promote"))


def champion_forecaster(spark, registry: str, nwp: DataFrame, stations: DataFrame) -> tuple[str, Forecaster, str | None]:
    """The registered champion with its ticket, or the official forecast while there is none."""
    record = T.load_champion(spark, registry)
    row = None if record is None else record.first()
    if row is None:
        return "official", official, None
    return f"champion:{row.rung}", model_forecaster(LadderModel.load(spark, row.model_path), nwp, stations), row.ticket


def promote_if_better(model: LadderModel, model_path: str, forecasts: DataFrame, obs: DataFrame, groups: DataFrame,
                      nwp: DataFrame, stations: DataFrame, registry: str, log: str, start=GATE_START, end=GATE_END,
                      register: bool = True, n_boot: int = HSS_REPLICATES) -> DataFrame:
    """Gate a model, log the decision, and register the model if it wins over the champion it met."""
    spark = forecasts.sparkSession
    name, incumbent, ticket = champion_forecaster(spark, registry, nwp, stations)
    score = lambda f: score_in_window(forecasts, obs, groups, f, start, end)
    decision = decide(pair(score(incumbent), score(model_forecaster(model, nwp, stations))), f"model:{model.rung}", name, n_boot)
    row = spark.createDataFrame(decision.collect(), decision.schema)  # one row
    T.log_experiment(row, log, "promotion_gate")
    if register and row.first()["promote"]:
        model.save(model_path)
        T.save_champion(row, registry, model.rung, model_path, ticket)
    return row
