"""Plans without all-pairs joins, and exact results when one station holds most rows."""

import bisect
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fcverify import catalog
from fcverify.operators import asof
from fcverify.operators.asof import asof_join, asof_lags
from fcverify.operators.nearest import align_hours

catalog.load()
OBS = "obs_id long, icao string, observed_at timestamp, vis_m double"


@pytest.fixture(scope="module")
def skewed(spark):
    """One station with most rows, one minute with a third of them."""
    rng = random.Random(1)
    base = __import__("datetime").datetime(2024, 1, 1, tzinfo=__import__("datetime").timezone.utc)
    rows = [(i, "HOT" if i % 10 else f"S{i % 7}", base + timedelta(minutes=90 if i % 3 == 0 else rng.randrange(0, 4000)), float(i)) for i in range(3000)]
    probes = [(i, "HOT" if i % 4 else "S3", base + timedelta(minutes=100 if i % 3 == 0 else rng.randrange(-50, 4200))) for i in range(1500)]
    return rows, probes


def frames(spark, skewed):
    rows, probes = skewed
    return spark.createDataFrame(rows, OBS), spark.createDataFrame(probes, "p long, icao string, at timestamp")


def history(rows, icao):
    best = {}
    for i, s, t, _ in rows:
        if s == icao:
            best[t] = max(i, best.get(t, -1))
    times = sorted(best)
    return times, [best[t] for t in times]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bucket", [600, 3600, 86400])
def test_asof_equals_search(spark, skewed, direction, bucket):
    obs, probes = frames(spark, skewed)
    got = {r.p: r.obs_id for r in asof_join(probes, obs, "at", ["obs_id"], direction=direction, bucket_seconds=bucket).select("p", "match.obs_id").collect()}
    assert len(got) == 1500
    for p, icao, t in skewed[1]:
        times, ids = history(skewed[0], icao)
        k = bisect.bisect_right(times, t) - 1 if direction == "backward" else bisect.bisect_left(times, t)
        assert got[p] == (ids[k] if 0 <= k < len(times) else None)


def test_lags_equal_search(spark, skewed):
    obs, probes = frames(spark, skewed)
    rows = asof_lags(probes, obs, "at", (0, 1, 6), ["obs_id"]).collect()
    assert len(rows) == len({(p[1], p[2]) for p in skewed[1]})
    for r in rows:
        times, ids = history(skewed[0], r.icao)
        for h in (0, 1, 6):
            t = r["at"].replace(tzinfo=times[0].tzinfo) - timedelta(hours=h)
            k = bisect.bisect_right(times, t) - 1
            match = r[f"lag_{h}"]
            assert (match.obs_id if match else None) == (ids[k] if k >= 0 else None)


def test_nearest_equals_search(spark, skewed):
    obs, probes = frames(spark, skewed)
    hours = probes.select("icao", F.date_trunc("hour", "at").alias("valid_hour")).distinct()
    for r in align_hours(hours, obs, [], how="left").collect():
        h = r.valid_hour.replace(tzinfo=skewed[0][0][2].tzinfo)
        near = [(abs(t - h), -t.timestamp(), -i) for i, s, t, _ in skewed[0] if s == r.icao and abs(t - h) <= timedelta(minutes=40)]
        assert (r.obs.obs_id if r.obs else None) == (-min(near)[2] if near else None)


@pytest.mark.parametrize("name", ["asof_latest_obs", "asof_lag_join", "nearest_obs", "nearest_obs_gate_window", "summary", "comparison", "persistence_bulk",
                                  "causal_features", "sequence_windows", "gate_window_scores", "keyed_append", "nearest_grid", "threshold_search"])
def test_no_all_pairs_joins(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["summary", "causal_features", "sequence_windows", "decode_obs"])
def test_no_python_in_the_data_path(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = catalog.QUERIES["forecast_hours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "value" not in schema


def test_a_hot_hour_is_cut_into_parts(spark, monkeypatch):
    """One station-hour with 10^6 distinct times: no task reads more than a twentieth of the rows, and all answers are right."""
    monkeypatch.setattr(asof, "SPLIT_ROWS", 40_000)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 1_000_000
        time = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3600)
        obs = spark.range(n).select(F.col("id").alias("obs_id"), F.lit("HOT").alias("icao"), time.alias("observed_at"))
        asked = spark.range(0, n, 5).select(F.lit("HOT").alias("icao"), (time + F.expr("interval 1 microsecond")).alias("at"))
        found = asof.asof_lags(asked, obs, "at", (0, 1), ["obs_id"])
        rows = found.select(F.spark_partition_id().alias("task"), F.col("lag_0.obs_id").alias("a"), F.col("lag_1.obs_id").alias("b"),
                            ((F.unix_micros("at") - 1_704_067_200_000_001) / 3600).cast("long").alias("want"))
        per = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("want")) | F.col("b").isNotNull()).alias("wrong"))
        per = per.collect()
        assert sum(r.n for r in per) == n // 5 and sum(r.wrong for r in per) == 0
        assert max(r.n for r in per) <= n // 5 / 20
        sizes = asof.hot_cuts(obs.select("icao", F.unix_micros("observed_at").alias("_key")), "icao", 3_600_000_000, 40_000)
        assert sizes.select("_part").distinct().count() == 24
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)


@pytest.mark.parametrize("split", [50, 7])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_cut_buckets_equal_search(spark, skewed, monkeypatch, split, direction):
    monkeypatch.setattr(asof, "SPLIT_ROWS", split)
    obs, probes = frames(spark, skewed)
    got = {r.p: r.obs_id for r in asof_join(probes, obs, "at", ["obs_id"], direction=direction).select("p", "match.obs_id").collect()}
    for p, icao, t in skewed[1]:
        times, ids = history(skewed[0], icao)
        k = bisect.bisect_right(times, t) - 1 if direction == "backward" else bisect.bisect_left(times, t)
        assert got[p] == (ids[k] if 0 <= k < len(times) else None)


def test_both_sides_of_cut_buckets(spark, skewed, monkeypatch):
    monkeypatch.setattr(asof, "SPLIT_ROWS", 20)
    monkeypatch.setattr(asof, "CUTS_SENT", 3)  # the list of cuts is joined by shuffling
    obs, probes = frames(spark, skewed)
    for r in asof.asof_sides(probes, obs, "at", ["obs_id"]).select("icao", "at", "match.obs_id", F.col("next.obs_id").alias("after")).collect():
        times, ids = history(skewed[0], r.icao)
        k = bisect.bisect_right(times, r["at"].replace(tzinfo=times[0].tzinfo))
        assert (r.obs_id, r.after) == (ids[k - 1] if k else None, ids[k] if k < len(times) else None)
