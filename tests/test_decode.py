from pyspark.sql import functions as F

from fcverify.operators import decode as D


def observations(spark, at, *texts):
    rows = [(i, "XXXX", at(2023, 6, 16, 12), t) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "id long, icao string, observed_at timestamp, raw_text string")
    return D.decode_observations(raw).orderBy("obs_id").collect()


def test_observation(spark, at):
    row, = observations(spark, at, "LEMD 161200Z 22015G25KT 6000 -RA BKN012 OVC025 14/11 Q1012 NOSIG")
    assert (row.icao, row.wind_dir_deg, row.wind_spd_kt, row.wind_gust_kt) == ("LEMD", 220, 15.0, 25.0)
    assert (row.vis_m, row.ceiling_ft, row.flight_category, row.weather) == (6000.0, 1200, "MVFR", ["-RA"])
    assert (row.temp_c, row.dewpoint_c, row.qnh_hpa) == (14.0, 11.0, 1012.0)
    assert row.clouds[0].asDict() == {"cover": "BKN", "base_ft": 1200, "cb": False}


def test_variable_wind_and_cavok(spark, at):
    row, = observations(spark, at, "LEBL 160600Z VRB02KT CAVOK 18/12 Q1018")
    assert row.wind_dir_deg is None and row.vis_m >= 10000 and row.flight_category == "VFR"


def test_odd_messages(spark, at):
    rows = observations(
        spark, at, "METAR COR LEVT 161230Z AUTO 00000MPS 0200 R04/0300 FG VV001 M02/M03 Q1030=",
        "LEMD 22015KT 9999 FEW020CB 20/10 A2992", "LEMD 161200Z 09010KT 1 1/2SM ///")
    assert rows[0].ceiling_ft == 100 and rows[0].temp_c == -2.0 and rows[0].weather == ["FG"]
    assert rows[0].flight_category == "LIFR" and rows[0].vis_m == 200.0
    assert rows[1].observed_at.hour == 12 and rows[1].clouds[0].cb and round(rows[1].qnh_hpa) == 1013
    assert rows[1].ceiling_ft is None and rows[1].vis_m == 10000.0
    assert rows[2].vis_m is None


def test_forecast(spark, at):
    text = ("TAF LEMD 161100Z 1612/1718 22012KT 9999 SCT025 BECMG 1615/1617 18008KT "
            "PROB30 TEMPO 1700/1706 3000 BR BKN004 FM171000 27015G25KT CAVOK")
    raw = spark.createDataFrame([(1, at(2023, 6, 16, 11), text), (2, at(2023, 6, 16, 11), "TAF LEMD NIL")],
                                "id long, issued_at timestamp, raw_text string")
    split = D.split_forecasts(raw)
    head, = D.forecast_headers(split).select("icao", F.col("valid_from").cast("string"), F.col("valid_to").cast("string")).collect()
    assert tuple(head) == ("LEMD", "2023-06-16 12:00:00", "2023-06-17 18:00:00")
    base, becmg, prob, fm = (D.forecast_groups(split).withColumns(
        {c: F.col(c).cast("string") for c in ("valid_from", "valid_to")}).orderBy("group_seq").collect())
    assert (base.group_type, base.wind_dir_deg, base.vis_m, base.flight_category) == ("BASE", 220, 10000.0, "VFR")
    assert (becmg.group_type, becmg.valid_to, becmg.vis_m) == ("BECMG", "2023-06-16 17:00:00", None)
    assert (prob.group_type, prob.probability, prob.vis_m, prob.ceiling_ft, prob.flight_category, prob.weather) == (
        "PROB30_TEMPO", 30, 3000.0, 400, "LIFR", ["BR"])
    assert (fm.group_type, fm.valid_from, fm.valid_to, fm.wind_gust_kt) == (
        "FM", "2023-06-17 10:00:00", "2023-06-17 18:00:00", 25.0)


def test_hour_24_and_plain_groups(spark, at):
    raw = spark.createDataFrame(
        [(1, at(2023, 1, 31, 17), "TAF AMD LEBL 311700Z 3118/0124 VRB03KT CAVOK TEMPO 3120/3124 1500 PROB40 0103/0106 0300 FG")],
        "id long, issued_at timestamp, raw_text string")
    split = D.split_forecasts(raw)
    assert str(D.forecast_headers(split).first().valid_to)[:13] == "2023-02-02 00"
    rows = D.forecast_groups(split).orderBy("group_seq").collect()
    assert [r.group_type for r in rows] == ["BASE", "TEMPO", "PROB40"]
    assert str(rows[1].valid_to)[:13] == "2023-02-01 00" and rows[2].probability == 40


def test_json_round_trip(spark):
    df = spark.createDataFrame([(1, '["a","b"]'), (2, "not json"), (3, None)], "id int, tags string")
    rows = {r.id: r for r in D.decode_nested(df, {"tags": "array<string>"}).collect()}
    assert rows[1].tags == ["a", "b"] and rows[2].tags is None and rows[2].tags_text == "not json" and rows[3].tags is None
