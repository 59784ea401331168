import os

from pyspark.sql import functions as F

from fcverify.operators.bootstrap import OUTCOMES
from fcverify.plans import backfill, gate
from fcverify.sources import feeds
from fcverify.sources import tables as T


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)


def test_observation_csv(spark, tmp_path):
    write(f"{tmp_path}/a/o.csv", "station,valid,metar\nLEMD,2023-06-16 12:00,LEMD 161200Z 1\nLEMD,2023-06-16 12:30, \n"
          "LEMD,2023-06-16 13:00,LEMD 161300Z 2\nLEMD,M,LEMD x\nLEMD,2024-01-01 00:00,LEMD late\n")
    rows = feeds.read_observation_csv(spark, f"{tmp_path}/a", "2023-06-16", "2023-06-17").collect()
    assert sorted(r.raw_text for r in rows) == ["LEMD 161200Z 1", "LEMD 161300Z 2"] and rows[0].source == "iem"


def test_granules_are_pruned(spark, tmp_path):
    head = "ESTACION,ANO,MES,DIA,HORA,MINUTO,PARTE\n"
    for prefix, year, station in (("LE", 2023, "LEMD"), ("LE", 2022, "LEMD"), ("GC", 2023, "GCLP")):
        write(f"{tmp_path}/g/prefix={prefix}/year={year}/f.csv",
              head + f"{station},{year},06,16,11,00,TAF {station} 161100Z=\n{station},{year},06,31,11,00,bad day=\nshort,row\n")
    df = feeds.read_granules(spark, f"{tmp_path}/g", ["LEMD"], "2023-01-01", "2024-01-01")
    assert [tuple(r) for r in df.select("icao", "raw_text").collect()] == [("LEMD", "TAF LEMD 161100Z")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("]")[0]
    assert "prefix" in filters and "year" in filters
    record = feeds.bulk_forecasts(df).first()
    assert record.source == "ogimet" and record.valid_from is None
    assert feeds.bulk_observations(df).first().observed_at.month == 6


def test_granule_audit(spark, tmp_path):
    write(f"{tmp_path}/raw/good.csv", "header\nTAF x\n")
    write(f"{tmp_path}/raw/tiny.csv", "TAF only\n")
    write(f"{tmp_path}/raw/none.csv", "header\nrow\n")
    keep = {os.path.basename(r.granule): r.keep for r in feeds.audit_folder(spark, f"{tmp_path}/raw").collect()}
    assert keep == {"good.csv": True, "tiny.csv": False, "none.csv": False}


def test_keyed_append(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("A", 1, None), ("A", 1, None), ("B", 2, "x")], "k string, t int, s string")
    assert T.keyed_append(rows, path, ["k", "t", "s"]) == 3  # copies in one batch stay
    assert T.keyed_append(rows, path, ["k", "t", "s"]) == 0  # NULL key parts compare equal
    more = spark.createDataFrame([("C", 1, None), ("C", 1, None)], rows.schema)
    assert T.keyed_append(more, path, ["k", "t", "s"], dedup_batch=True) == 1
    assert spark.read.parquet(path).count() == 4


def test_stages_are_restartable(spark, tmp_path, at):
    store = backfill.Store(spark, str(tmp_path))
    taf = "TAF LEMD 161100Z 1612/1618 22012KT 9999 BKN025 TEMPO 1614/1616 0800 FG"
    raw = spark.createDataFrame([("LEMD", at(2023, 6, 16, 11), None, None, taf, "ogimet"), ("LEMD", at(2023, 6, 16, 17), None, None, "garbage", "ogimet")],
                                "icao string, issued_at timestamp, valid_from timestamp, valid_to timestamp, raw_text string, source string")
    obs = spark.createDataFrame([("LEMD", at(2023, 6, 16, h), f"LEMD 16{h:02d}00Z 22012KT {v} OVC008 10/10 Q1010", "iem")
                                 for h, v in ((12, "9999"), (13, "0800"), (14, "0500"), (15, "9999"))],
                                "icao string, observed_at timestamp, raw_text string, source string")
    assert T.store_raw(raw, store.path("raw_taf"), "raw_taf") == 2 and T.store_raw(raw, store.path("raw_taf"), "raw_taf") == 0
    assert T.store_raw(obs, store.path("raw_metar"), "raw_metar") == 4
    assert backfill.decode_pending_observations(store) == 4 and backfill.decode_pending_observations(store) == 0
    assert backfill.decode_pending_forecasts(store) == 1 and backfill.decode_pending_forecasts(store) == 0
    T.seed_stations(spark).write.parquet(store.path("stations"))
    assert backfill.verify_pending(store, ["categorical", "climatology"]) == {"categorical": 4, "climatology": 4}
    assert backfill.verify_pending(store, ["categorical"]) == {"categorical": 0}
    rows = {r.valid_hour.hour: r for r in store.read("verification_hourly").filter("scoring_profile = 'categorical'").collect()}
    assert rows[14].category_outcome == "hit" and rows[14].fcst_prob == 0.4 and rows[13].category_outcome == "miss"
    backfill.rescore(store, ["categorical"])
    counts = {r.table_name: r.n for r in backfill.status(store).collect()}
    assert counts["verification_hourly"] == 8 and counts["taf_group"] == 2 and counts["stations"] == 24


def test_upsert(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    new = spark.createDataFrame([("B", None), ("C", 3)], "k string, v int")
    assert sorted((r.k, r.v) for r in T.upsert(new, old, "k").collect()) == [("A", 1), ("B", None), ("C", 3)]


def test_log_and_champion(spark, tmp_path):
    registry, log = f"{tmp_path}/champion", f"{tmp_path}/log"
    assert T.load_champion(spark, registry) is None and T.read_log(spark, log) is None
    pairs = spark.createDataFrame([(OUTCOMES[i % 2 * 3], OUTCOMES[i % 4], .5, .4, int(i % 4 < 2)) for i in range(80)],
                                  "champion string, challenger string, p_champion double, p_challenger double, event int")
    decision = gate.decide(pairs, "model:linreg", n_boot=20)
    T.log_experiment(decision, log, "promotion_gate")
    first = T.save_champion(decision, registry, "linreg", "/models/1")
    assert T.load_champion(spark, registry).first().ticket == first
    T.save_champion(decision, registry, "rf", "/models/0")  # gated against the official forecast too, but late
    assert T.load_champion(spark, registry).first().ticket == first
    T.save_champion(decision, registry, "gbm", "/models/2", first)
    assert T.load_champion(spark, registry).first().model_path == "/models/2"
    assert T.read_log(spark, log).filter(F.col("record").contains("n_paired")).count() == 1


def test_promotions_at_once_leave_one_champion():
    record = lambda ticket, base, at: {"ticket": ticket, "base": base, "promoted_at": at}
    a, b = record("a", None, 2), record("b", None, 1)
    assert T.champion_tickets([]) == [] and T.champion_tickets([a, b]) == T.champion_tickets([b, a]) == ["b"]
    # what others were built on stays, though an earlier record turns up
    assert T.champion_tickets([a, record("c", "a", 3), b]) == ["a", "c"]
    assert T.champion_tickets([a, record("c", "a", 3), record("d", "a", 3), record("e", "zzz", 0)]) == ["a", "c"]
    chain = [record(str(i), str(i - 1) if i else None, i) for i in range(5000)]
    assert T.champion_tickets(chain)[-1] == "4999"
