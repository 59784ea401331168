import pytest
from pyspark.sql import functions as F

from fcverify.functions import conditions as C
from fcverify.functions import scoring as S
from fcverify.functions.timetokens import hour_boundaries, lead_bucket, lead_hours, resolve_time, validity_hours
from fcverify.functions.nwp import wind_from_direction


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[0]


@pytest.mark.parametrize("token,metres", [
    ("6000", 6000.0), ("9999", 10000.0), (">10000", 10000.0), (None, None), ("", None), ("2SM", 3218.68),
    ("1/2SM", None), ("ABC", None), (">6SM", 9656.04), (" < 800", 800.0)])
def test_visibility(spark, token, metres):
    got = one(spark, C.visibility_m(F.lit(token).cast("string")))
    assert got == (None if metres is None else pytest.approx(metres))


@pytest.mark.parametrize("ceiling,vis,category", [
    (5000, 9999.0, "VFR"), (2000, 9999.0, "MVFR"), (5000, 3000.0, "IFR"), (300, 9999.0, "LIFR"), (None, None, None),
    (None, 9999.0, "VFR"), (500, 1600.0, "IFR"), (1000, 4800.0, "MVFR"), (3000, 8000.0, "VFR"), (300, None, "LIFR")])
def test_flight_category(spark, ceiling, vis, category):
    got = one(spark, C.flight_category(F.lit(ceiling).cast("int"), F.lit(vis).cast("double")))
    assert got == category


def test_own_band_table(spark):
    got = one(spark, C.flight_category(F.lit(800), F.lit(9999.0), {"LIFR": 200, "IFR": 700, "MVFR": 1000}))
    assert got == "MVFR"


@pytest.mark.parametrize("day,hour,expected", [(1, 5, (2023, 2, 1, 5)), (31, 24, (2023, 2, 1, 0)), (31, 22, (2023, 1, 31, 22))])
def test_resolve_time(spark, at, day, hour, expected):
    got = one(spark, resolve_time(F.lit("2023-01-31 23:00:00").cast("timestamp"), F.lit(day), F.lit(hour)).cast("string"))
    assert got == at(*expected).strftime("%Y-%m-%d %H:%M:%S")


def test_resolve_time_without_such_a_day(spark):
    assert one(spark, resolve_time(F.lit("2023-06-15 00:00:00").cast("timestamp"), F.lit(32), F.lit(1))) is None


@pytest.mark.parametrize("a,b,gap", [(350, 10, 20), (10, 350, 20), (None, 10, None), (0, 180, 180)])
def test_angle(spark, a, b, gap):
    assert one(spark, S.angular_difference(F.lit(a).cast("double"), F.lit(b).cast("double"))) == gap


def test_leads_round_down(spark):
    issue, valid = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:50:00", "2024-01-01 02:10:00"))
    assert one(spark, lead_hours(valid, issue)) == 1
    assert one(spark, lead_hours(issue, valid)) == -2
    assert one(spark, hour_boundaries(issue, valid)) == 2
    assert one(spark, lead_bucket(F.lit(-5))) == -6


def test_validity_hours(spark):
    ts = lambda t: F.lit(t).cast("timestamp")
    assert len(one(spark, validity_hours(ts("2024-01-01 00:20:00"), ts("2024-01-01 03:00:00")))) == 3
    assert one(spark, validity_hours(ts("2024-01-01 03:00:00"), ts("2024-01-01 02:00:00"))) is None


def test_calm_and_north_wind(spark):
    assert one(spark, wind_from_direction(F.lit(0.0), F.lit(-5.0))) == 0.0
    assert one(spark, wind_from_direction(F.lit(0.0), F.lit(0.0))) == 180.0
