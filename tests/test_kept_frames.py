from types import SimpleNamespace

from pyspark.sql import functions as F

from fcverify.catalog import ensembles
from fcverify.operators.nearest import align_hours_within
from fcverify.operators.verification import pending
from fcverify.plans import ladder
from fcverify.session import kept
from fcverify.sources.tables import not_stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_cuts_the_lineage(spark):
    rows = spark.range(9).join(spark.range(3, 20), "id").withColumn("s", F.struct("id"))
    out = kept(rows)
    assert "Join" not in plan(out) and out.dtypes == rows.dtypes
    assert sorted(r["id"] for r in out.collect()) == [3, 4, 5, 6, 7, 8]


def test_points_are_scored_once(spark):
    other = spark.range(40).select("id", F.rand(1).alias("p2"))
    points = spark.range(40).join(other, "id").select(
        F.expr("timestamp '2024-01-25' + make_dt_interval(0, id)").alias("valid_hour"), F.lit(1).alias("lead_h"),
        (F.col("id") % 2).alias("event"), F.col("p2").alias("p"), "p2", F.col("p2").alias("p_official"))
    early, late = ensembles._parts(SimpleNamespace(model_points=points))
    assert "Join" not in plan(early) and "Join" not in plan(late)
    assert (early.count(), late.count()) == (24, 16)


def test_history_is_not_broadcast(spark):
    rows = spark.range(20).withColumn("k", F.col("id") % 3)
    fresh = not_stored(rows, rows.filter("id < 5"), ["id", "k"])
    assert "SortMergeJoin" in plan(fresh) and "Broadcast" not in plan(fresh) and fresh.count() == 15
    heads = spark.range(9).select(F.col("id").alias("taf_id"), F.lit(1).alias("valid_from"), F.lit(2).alias("valid_to"))
    todo = pending(heads, heads.filter("taf_id < 4"))
    assert "Broadcast" not in plan(todo) and todo.count() == 5


def test_the_choice_of_an_observation_stands_behind_a_barrier(spark, at):
    obs = spark.createDataFrame([(1, "A", at(2024, 1, 1, 5, 50), 7.0), (2, "A", at(2024, 1, 1, 6, 5), 8.0)], "obs_id long, icao string, observed_at timestamp, vis_m double")
    hours = spark.createDataFrame([("A", at(2024, 1, 1, 5), at(2024, 1, 1, 9), at(2024, 1, 1, 6))], "icao string, valid_from timestamp, valid_to timestamp, valid_hour timestamp")
    out = align_hours_within(hours, obs, ["vis_m"])
    assert "Generate inline" in plan(out)
    assert [r["obs"]["vis_m"] for r in out.collect()] == [8.0]


def test_the_ladder_keeps_what_it_reads(spark):
    columns = ["t0", "o0_time", "valid_time", "obs_id", "icao", "region", "f_a", *ladder.REGRESSION_TARGETS, "y_has_ceiling", "y_cat"]
    samples = spark.range(1).select(*[F.lit(1).alias(c) for c in columns])
    assert not {"o0_time", "valid_time", "obs_id"} & set(ladder._fitted_columns(samples).columns)
