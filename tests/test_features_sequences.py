import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fcverify.functions import sampling as P
from fcverify.operators import features as X
from fcverify.operators import grid as G
from fcverify.operators import sequences as Q
from fcverify.schema import NWP_POINT, STATIONS

HISTORY = ("obs_id long, icao string, observed_at timestamp, vis_m double, ceiling_ft int, wind_spd_kt double, wind_dir_deg int, "
           "temp_c double, dewpoint_c double, flight_category string")


def history(spark, at, n_hours, icao="LEMD", skip=(), ids=0):
    """Hourly observations; visibility is the hour's number, fog at 06Z."""
    rows = []
    for i in range(n_hours):
        t = at(2023, 6, 1) + timedelta(hours=i)
        fog = t.hour == 6
        if i not in skip:
            rows.append((ids + i, icao, t, float(i), 200 if fog else None, 5.0, 90, 12.0, 10.0, "LIFR" if fog else "VFR"))
    return spark.createDataFrame(rows, HISTORY)


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([("LEMD", "Madrid", 40.5, -3.5, 610, "peninsula"), ("LEBL", "Barcelona", 41.3, 2.1, 4, "peninsula")], STATIONS)


@pytest.fixture(scope="module")
def no_nwp(spark):
    return spark.createDataFrame([], NWP_POINT)


def test_samples_are_causal(spark, at, stations, no_nwp):
    rows = X.training_samples(history(spark, at, 48), no_nwp, stations, leads=(1, 3, 6))
    assert X.leakage(rows).isEmpty()
    assert len(X.feature_columns(rows)) == 54 and len(X.target_columns(rows)) == 8
    row = rows.filter("lead_h = 3 and y_vis_m = 20").first()
    assert row.f_o0_vis == 17.0 and row.f_o1_vis == 16.0 and row.f_dvis_6 == 6.0 and row.f_et_t2m is None
    assert row.f_o0_ceiling == 30000.0 and row.f_o0_has_ceiling == 0 and row.f_o0_spread == 2.0
    assert row.f_o0_wdir_sin == pytest.approx(1.0) and row.f_hod_sin == pytest.approx(math.sin(2 * math.pi * 20 / 24))
    fog = rows.filter("y_cat = 'LIFR' and lead_h = 1").first()
    assert fog.y_ceiling_ft == 200.0 and fog.y_has_ceiling == 1


def test_requests_equal_samples(spark, at, stations, no_nwp):
    obs = history(spark, at, 48)
    train = X.training_samples(obs, no_nwp, stations, leads=(3,)).filter("y_vis_m between 10 and 30")
    asked = X.request_features(train.select("icao", "t0", "valid_time"), obs, no_nwp, stations)
    columns = ["t0", "valid_time", *X.feature_columns(asked)]
    assert train.select(columns).exceptAll(asked.select(columns)).isEmpty() and asked.count() == train.count()


def test_stale_anchor_is_dropped(spark, at, stations, no_nwp):
    obs = history(spark, at, 30, skip=range(5, 15))  # last before the gap is hour 4
    ages = X.training_samples(obs, no_nwp, stations, leads=(1,)).select(F.col("y_vis_m") - 1 - F.col("f_o0_vis")).collect()
    assert max(r[0] for r in ages) <= 6
    lead1 = {r[0] for r in X.training_samples(obs, no_nwp, stations, leads=(1,)).select("y_vis_m").collect()}
    assert 15.0 not in lead1 and 16.0 in lead1


def test_splits_and_samples(spark, at):
    rows = history(spark, at, 240).withColumn("t0", F.col("observed_at"))
    split = rows.groupBy(P.split_name(F.col("t0"), "2023-06-05", "2023-06-08").alias("s")).agg(F.min("t0").alias("a"), F.max("t0").alias("b"))
    got = {r.s: r for r in split.collect()}
    assert got["train"].b < got["val"].a < got["val"].b < got["test"].a
    few = P.keep_percent(rows, P.hash_percent(F.col("t0")), 20).count()
    assert 20 < few < 80 and P.keep_percent(rows, P.hash_percent(F.col("t0")), 100).count() == 240


def test_sequences(spark, at, stations, no_nwp):
    obs = history(spark, at, 40 * 24).unionByName(history(spark, at, 40 * 24, "LEBL", skip=(100, 101, 102), ids=10_000))
    rows = Q.build_sequences(obs, no_nwp, stations)
    first = rows.filter("icao = 'LEMD'").orderBy("t0").first()
    assert (len(first.x_past), len(first.x_past[0]), len(first.x_future), len(first.x_future[0])) == (12, 10, 30, 15)
    assert (len(first.y_reg), len(first.y_reg[0]), len(first.x_static)) == (30, 5, 3)
    assert [s[0] for s in first.x_past] == [float(i) for i in range(12)]  # first issue is hour 11
    assert [s[10] for s in first.x_future] == [float(i) for i in range(1, 31)]
    assert [s[0] for s in first.y_reg] == [float(i) for i in range(12, 42)]
    n = rows.groupBy("icao").count().collect()
    assert {r["icao"]: r["count"] for r in n} == {"LEMD": 960 - 41, "LEBL": 960 - 41}
    # Every window of every block, not only those inside one.
    shifted = rows.filter("icao = 'LEMD'").filter(F.expr("x_past[11][0] + 1 <> y_reg[0][0] or x_past[0][0] + 11 <> x_past[11][0]"))
    assert shifted.isEmpty()
    gap = rows.filter("icao = 'LEBL'").filter(F.col("t0") == at(2023, 6, 5, 3)).first()  # hour 99
    assert gap.y_mask[:4] == [0.0, 0.0, 0.0, 1.0] and gap.y_cat[:3] == [-1, -1, -1]
    assert {(r.icao, r.station_id) for r in rows.select("icao", "station_id").distinct().collect()} == {("LEBL", 0), ("LEMD", 1)}
    part = Q.sequence_windows(obs, no_nwp, stations, sample_pct=25).count()
    assert 0.1 < part / (2 * (960 - 41)) < 0.4
    splits = Q.split_sequences(rows, "2023-06-20", "2023-07-01").groupBy("split").count().count()
    assert splits == 3


def test_short_history_has_no_sequences(spark, at, stations, no_nwp):
    assert Q.sequence_windows(history(spark, at, 42), no_nwp, stations).isEmpty()
    assert Q.sequence_windows(history(spark, at, 43), no_nwp, stations).count() == 2


def test_grid_points(spark, at, stations):
    cells = [(at(2023, 6, 1), lat, lon, 0.0, -5.0, 10.0, 283.15, float("nan"), 0.002, 101300.0)
             for lat in (40.0, 40.5, 41.0) for lon in (-4.0, -3.5, 2.0)]
    grid = spark.createDataFrame(cells, "time timestamp, latitude double, longitude double, u10 double, v10 double, fg10 double, t2m double, "
                                        "d2m double, tp double, msl double")
    rows = {r.icao: r for r in G.extract_points(grid, stations).collect()}
    row = rows["LEMD"]
    assert row.wind10m_spd == pytest.approx(9.7192) and row.wind10m_dir == 0.0 and row.t2m_c == pytest.approx(10.0)
    assert row.tp_mm == pytest.approx(2.0) and row.mslp_hpa == 1013.0 and row.d2m_c is None and row.tcc is None
    cells = {r.icao: (r.latitude, r.longitude) for r in G.station_cells(grid, stations).collect()}
    assert cells == {"LEMD": (40.5, -3.5), "LEBL": (41.0, 2.0)}
    points = G.point_records(grid.filter("latitude = 40 and longitude = 2").withColumnsRenamed({"time": "valid_time", "fg10": "i10fg"}).withColumn("icao", F.lit("X")))
    assert points.first().gust == pytest.approx(19.4384)
