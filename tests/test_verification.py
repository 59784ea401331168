import pandas as pd
import pytest
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.functions.conditions import state
from fcverify.operators import forecasters as FC
from fcverify.operators import rollups as R
from fcverify.operators.expand import expand
from fcverify.operators.nearest import align_hours, align_hours_within
from fcverify.operators.verification import OBSERVED, pending, score_hours, score_own_window, score_profile
from fcverify.schema import PROB_STATE, STATE

GROUP = ("taf_id long, group_seq int, group_type string, probability int, valid_from timestamp, valid_to timestamp, wind_dir_deg int, "
         "wind_spd_kt double, wind_gust_kt double, vis_m double, ceiling_ft int, flight_category string")
OBS = ("obs_id long, icao string, observed_at timestamp, wind_dir_deg int, wind_spd_kt double, wind_gust_kt double, vis_m double, "
       "ceiling_ft int, flight_category string")


def taf(spark, at, start, end, taf_id=1):
    return spark.createDataFrame([(taf_id, "LEMD", at(2023, 6, 16, start), at(2023, 6, 16, start), at(2023, 6, 16, end))],
                                 "taf_id long, icao string, issued_at timestamp, valid_from timestamp, valid_to timestamp")


def group(at, seq, kind, start, end, vis=None, ceil=None, cat=None, prob=None, spd=None, direction=None):
    return (1, seq, kind, prob, at(2023, 6, 16, start), at(2023, 6, 16, end), direction, spd, None, vis, ceil, cat)


def test_fm_and_tempo(spark, at):
    groups = spark.createDataFrame([
        group(at, 0, "BASE", 0, 6, 10000.0, None, "VFR", spd=5.0, direction=90), group(at, 1, "FM", 3, 6, 3000.0, 800, "IFR", spd=9.0),
        group(at, 2, "TEMPO", 2, 4, 500.0, 100, "LIFR")], GROUP)
    rows = {r.valid_hour.hour: r for r in expand(taf(spark, at, 0, 6), groups).collect()}
    assert len(rows) == 6 and rows[2].prevailing.flight_category == "VFR" and rows[3].prevailing.flight_category == "IFR"
    assert rows[3].prevailing.wind_dir_deg is None  # FM replaces every element
    assert rows[1].tempo is None and rows[2].tempo.flight_category == "LIFR" and rows[4].tempo is None


def test_becmg_merges_at_its_end_and_last_overlay_wins(spark, at):
    groups = spark.createDataFrame([
        group(at, 0, "BASE", 0, 8, 10000.0, 400, "LIFR", spd=5.0), group(at, 1, "BECMG", 2, 4, 2000.0, None, "IFR"),
        group(at, 2, "PROB30", 0, 8, 900.0, 100, "LIFR", 30), group(at, 3, "PROB40_TEMPO", 5, 6, 4000.0, 900, "IFR", 40)], GROUP)
    rows = {r.valid_hour.hour: r for r in expand(taf(spark, at, 0, 8), groups).collect()}
    assert rows[3].prevailing.vis_m == 10000.0 and rows[4].prevailing.vis_m == 2000.0
    assert rows[4].prevailing.ceiling_ft == 400.0 and rows[4].prevailing.flight_category == "LIFR"
    assert rows[4].prob.probability == 30 and rows[5].prob.probability == 40


def test_copies_of_groups_and_missing_base(spark, at):
    fm = group(at, 1, "FM", 3, 6, 3000.0, 800, "IFR")
    rows = {r.valid_hour.hour: r for r in expand(taf(spark, at, 0, 6), spark.createDataFrame([fm] * 50, GROUP)).collect()}
    assert rows[0].prevailing.vis_m is None and rows[0].prevailing.flight_category is None and rows[5].prevailing.vis_m == 3000.0
    none = expand(taf(spark, at, 0, 6), spark.createDataFrame([], GROUP)).collect()
    assert len(none) == 6 and none[0].prevailing.flight_category is None


def hours(spark, at, *hs):
    rows = [("LEMD", 1, at(2023, 6, 16, h)) for h in hs]
    return spark.createDataFrame(rows, "icao string, taf_id long, valid_hour timestamp")


def obs_at(spark, at, *minutes):
    base = at(2023, 6, 16, 12)
    return spark.createDataFrame([(i, "LEMD", base + pd.Timedelta(minutes=m).to_pytimedelta(), 10, 5.0, None, 9999.0, None, "VFR")
                                  for i, m in enumerate(minutes)], OBS)


@pytest.mark.parametrize("minutes,chosen", [((-50, 20, 90), 1), ((-40,), 0), ((-41,), None), ((-10, 10), 1), ((0, 0), 1), ((-5, 30), 0)])
def test_nearest(spark, at, minutes, chosen):
    rows = align_hours(hours(spark, at, 12), obs_at(spark, at, *minutes), OBSERVED, how="left").collect()
    assert (rows[0].obs.obs_id if rows[0].obs else None) == chosen


def test_nearest_within_window(spark, at):
    grid = hours(spark, at, 12, 13).withColumns({"valid_from": F.lit(at(2023, 6, 16, 12)), "valid_to": F.lit(at(2023, 6, 16, 13)) + F.expr("interval 10 minutes")})
    obs = obs_at(spark, at, -5, 30, 75)
    got = {r.valid_hour.hour: r.obs.obs_id for r in align_hours_within(grid, obs, []).collect()}
    assert got == {12: 1, 13: 1}  # -5 precedes the first hour, 75 follows the end
    start = grid.withColumn("valid_from", F.col("valid_from") + F.expr("interval 20 minutes"))
    near = {r.valid_hour.hour: r.obs.obs_id for r in align_hours_within(start, obs_at(spark, at, 10, 25), [], lower="valid_from").collect()}
    assert near == {12: 1, 13: 1} # 10 precedes the start


def scored(spark, prevailing, tempo, prob, obs_cat, at):
    one = spark.range(1).select(
        F.lit(1).cast("long").alias("taf_id"), F.lit("LEMD").alias("icao"), F.lit(at(2023, 6, 16, 12)).alias("valid_hour"),
        F.lit(at(2023, 6, 16, 11)).alias("issued_at"),
        state(**{"flight_category": F.lit(prevailing), **{e: F.lit(100.0) for e in STATE.names[:-1]}}).alias("prevailing"),
        (state(**{"flight_category": F.lit(tempo), **{e: F.lit(None) for e in STATE.names[:-1]}}) if tempo else F.lit(None).cast(STATE)).alias("tempo"),
        (F.struct(*[F.lit(None).cast("double").alias(e) for e in STATE.names[:-1]], F.lit(prob[0]).alias("flight_category"),
                  F.lit(prob[1]).cast("int").alias("probability")) if prob else F.lit(None).cast(PROB_STATE)).alias("prob"),
        F.struct(F.lit(90).alias("wind_dir_deg"), F.lit(90.0).alias("wind_spd_kt"), F.lit(50.0).alias("vis_m"), F.lit(None).cast("int").alias("ceiling_ft"),
                 F.lit(obs_cat).cast("string").alias("flight_category")).alias("obs"))
    return score_hours(one).first()


@pytest.mark.parametrize("prevailing,tempo,prob,obs,outcome,p,weight", [
    ("VFR", "LIFR", None, "LIFR", "hit", 0.4, 2.0), ("LIFR", None, None, "VFR", "false_alarm", 1.0, 0.0), ("VFR", None, None, "VFR", "correct_neg", 0.0, 3.0),
    ("VFR", None, ("IFR", 30), "IFR", "hit", 0.3, 1.0), ("VFR", None, ("IFR", 40), "IFR", "hit", 0.4, 1.5), ("MVFR", None, None, "IFR", "miss", 0.0, 1.0),
    ("VFR", None, ("IFR", None), "IFR", "hit", 0.4, 1.0), ("LIFR", None, None, None, "false_alarm", 1.0, 0.0)])
def test_scores(spark, at, prevailing, tempo, prob, obs, outcome, p, weight):
    row = scored(spark, prevailing, tempo, prob, obs, at)
    assert (row.category_outcome, row.fcst_prob, row.weighted_score) == (outcome, p, weight)
    assert (row.wind_err_kt, row.vis_err_m, row.ceiling_err_ft, row.dir_err_deg, row.temp_err_c) == (10.0, 50.0, None, 10.0, None)


def test_baselines(spark, at):
    obs = obs_at(spark, at, -90, 10, 70)
    forecast = taf(spark, at, 12, 14)
    assert FC.persistence(forecast, obs).count() == 2
    bulk = FC.issue_anchor(forecast, obs, look_ahead=True).first()
    assert bulk.anchor.matched_at.minute == 10  # nearest on either side
    assert FC.issue_anchor(forecast, obs, look_ahead=False).first().anchor.matched_at.hour == 10
    early = obs.filter("obs_id = 2").withColumn("observed_at", F.col("observed_at") + F.expr("interval 5 hours"))
    assert FC.persistence_bulk(forecast, early).count() == 0 and FC.persistence(forecast, early).first().prevailing.vis_m is None
    clim = FC.climatology_bulk(forecast, obs).orderBy("valid_hour").collect()
    assert clim[0].fcst_prob == 0.0 and clim[0].prevailing.flight_category == "VFR"


def test_pending_is_per_profile(spark, at):
    obs, forecast = obs_at(spark, at, 0, 60), taf(spark, at, 12, 14)
    groups = spark.createDataFrame([group(at, 0, "BASE", 12, 14, 9999.0, None, "VFR")], GROUP)
    rows = score_profile(forecast, obs, groups, "categorical")
    assert rows.count() == 2 and pending(forecast, rows, "categorical").count() == 0
    assert pending(forecast, rows, "persistence").count() == 1 and pending(forecast, rows).count() == 0
    assert score_own_window(forecast, obs, groups).count() == 2


def test_skill_of_nothing_is_null(spark, at):
    empty = spark.createDataFrame([], "category_outcome string")
    row = R.contingency(empty).first()
    assert row.n == 0 and row.POD is None and row.HSS is None


def test_brier(spark):
    rows = spark.createDataFrame([(.1, 0)] * 5 + [(.2, 0)] + [(.8, 1)] * 2, "p double, event int")
    skilled = rows.agg(S.brier_skill(F.col("p"), F.col("event"))).first()[0]
    inverted = rows.agg(S.brier_skill(1 - F.col("p"), F.col("event"))).first()[0]
    assert skilled > 0 > inverted
    assert rows.filter("event = 0").agg(S.brier_skill(F.col("p"), F.col("event"))).first()[0] is None
