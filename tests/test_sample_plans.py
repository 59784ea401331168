import pytest
from pyspark.sql import functions as F

from fcverify.operators import asof
from fcverify.operators import features as X
from fcverify.schema import NWP_POINT, STATIONS

HOUR = 3_600_000_000


@pytest.fixture
def samples(spark, tmp_path):
    """Samples over stored observations that are few enough to be broadcast."""
    rows = spark.range(300).select(
        F.col("id").alias("obs_id"), F.lit("LEMD").alias("icao"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1800).alias("observed_at"),
        F.col("id").cast("double").alias("vis_m"), F.lit(None).cast("int").alias("ceiling_ft"), F.lit(5.0).alias("wind_spd_kt"),
        F.lit(90).alias("wind_dir_deg"), F.lit(12.0).alias("temp_c"), F.lit(10.0).alias("dewpoint_c"), F.lit("VFR").alias("flight_category"))
    rows.write.parquet(f"{tmp_path}/obs")
    stations = spark.createDataFrame([("LEMD", "Madrid", 40.5, -3.5, 610, "peninsula")], STATIONS)
    return X.training_samples(spark.read.parquet(f"{tmp_path}/obs"), spark.createDataFrame([], NWP_POINT), stations)


def test_samples_and_their_issue_times_are_not_broadcast(samples, capsys):
    samples.groupBy("icao").count().explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join [icao#" in line and "t0#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_targets_multiply_by_lead_behind_a_shuffle(samples, capsys):
    samples.explain()
    lines = capsys.readouterr().out.splitlines()
    leads = [i for i, line in enumerate(lines) if "Generate explode([1,2,3,6" in line]
    assert leads
    for i in leads:
        depth = min(lines[i].index(c) for c in "G")
        below = []
        for line in lines[i + 1:]:
            if len(line) - len(line.lstrip(" :+-")) <= depth - 3:
                break
            below.append(line)
        scan = next(k for k, line in enumerate(below) if "Scan parquet" in line)
        assert any("Exchange hashpartitioning" in line for line in below[:scan])


def test_averages_of_all_features_are_one_loop(samples, capsys):
    names = X.feature_columns(samples) + [c for c in X.target_columns(samples) if c != "y_cat"]
    samples.groupBy("icao", "lead_h").agg(*[F.avg(c) for c in names]).write.format("noop").mode("overwrite").save()
    assert int(samples.sparkSession.conf.get("spark.sql.codegen.maxFields")) > 2 * len(names) + 2


@pytest.mark.parametrize("minutes", [15, 60, 90])
def test_moved_counts_equal_counts_of_moved_rows(spark, minutes):
    width, lags = minutes * 60_000_000, (0, 1, 3, 6)
    times = [i * 977_000_003 % (40 * HOUR) - 3 * HOUR for i in range(200)] + [0, HOUR, HOUR - 1, width, -1]
    keys = spark.createDataFrame([("A" if t % 2 else "B", t) for t in times], "icao string, _key long")
    want = {}
    for t in times:
        for h in lags:
            at = ("A" if t % 2 else "B", (t + h * HOUR) // width)
            want[at] = want.get(at, 0) + 1
    got = asof.bucket_counts(keys, "icao", width, lags)
    assert {(r["icao"], r["_bucket"]): r["n"] for r in got.collect()} == want
