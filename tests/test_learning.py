import math

import pytest
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.operators import bootstrap as B
from fcverify.operators import probgroups as G
from fcverify.operators import quantiles as N
from fcverify.operators import thresholds as T
from fcverify.plans import ensemble as E
from fcverify.plans import ladder as L


@pytest.mark.parametrize("p,commit,kind", [(.9, True, None), (.05, False, None), (.30, False, "PROB30"), (.40, False, "PROB40"),
                                           (.14, False, None), (.15, False, None), (.71, True, None)])
def test_quantise(spark, p, commit, kind):
    row = spark.range(1).select(*[c.alias(n) for n, c in G.quantised(F.lit(p)).items()]).first()
    assert (row.commit, row.group_type) == (commit, kind)


def test_generated_hours_round_trip(spark):
    vec = lambda v, c: F.struct(F.lit(v).alias("vis"), F.lit(c).alias("ceiling"), F.lit(5.0).alias("wspd"),
                                F.lit(0.0).alias("wdir_sin"), F.lit(1.0).alias("wdir_cos"))
    rows = spark.createDataFrame([(i, i / 20) for i in range(21)], "i int, p_adverse double").withColumns(
        {"q10": vec(300.0, 100.0), "q50": vec(9999.0, 30000.0)})
    out = G.hours_from_quantiles(rows).withColumn("stated", S.adverse_probability(F.col("prevailing"), F.col("tempo"), F.col("prob")))
    out = out.orderBy("i").collect()
    stated = [r.stated for r in out]
    assert stated == sorted(stated) and set(stated) == {0.0, 0.3, 0.4, 1.0}
    assert all(abs(r.stated - r.p_adverse) <= min(abs(b - r.p_adverse) for b in (0, .3, .4, 1)) + 1e-12 for r in out)
    assert out[20].prevailing.flight_category == "LIFR" and out[20].prevailing.vis_m == 300.0
    assert out[6].prob.probability == 30 and out[6].prevailing.flight_category == "VFR" and out[6].prob.ceiling_ft == 100.0


def outcomes(spark, pairs):
    return spark.createDataFrame([p for p, n in pairs for _ in range(n)], "champion string, challenger string")


@pytest.mark.parametrize("pairs,wins", [
    ([(("miss", "hit"), 60), (("false_alarm", "correct_neg"), 60), (("hit", "hit"), 40), (("correct_neg", "correct_neg"), 200)], True),
    ([(("hit", "miss"), 60), (("correct_neg", "false_alarm"), 60), (("hit", "hit"), 40), (("correct_neg", "correct_neg"), 200)], False),
    ([(("hit", "hit"), 40), (("miss", "miss"), 10), (("correct_neg", "correct_neg"), 200)], False)])
def test_bootstrap_of_hss(spark, pairs, wins):
    row = B.bootstrap_hss(outcomes(spark, pairs), n_boot=200).first()
    assert row.wins is wins and row.ci_low <= row["diff"] <= row.ci_high


def test_bootstrap_of_nothing(spark):
    row = B.bootstrap_hss(outcomes(spark, []), n_boot=20).first()
    assert row["diff"] is None and row.ci_low is None and row.wins is False


def test_bootstrap_of_bss_does_not_depend_on_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 10 / 10).alias("p"), ((F.col("id") * 7 % 10) < F.col("id") % 10).cast("int").alias("event"))
    a, b = (B.bss_replicates(df, n_boot=100).orderBy("rep").collect() for df in (rows, rows.repartition(7)))
    assert all(math.isclose(x.bss, y.bss, rel_tol=1e-9) for x, y in zip(a, b))
    point = rows.agg(S.brier_skill(F.col("p"), F.col("event"))).first()[0]
    ends = B.bootstrap_bss(rows, n_boot=300).first()
    assert ends.low < point < ends.high


def test_quantiles_of_a_hot_group(spark):
    """One group with a third of the rows on a single value, against the built-in."""
    rows = spark.range(9000).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 3 == 0, 700.0).otherwise((F.col("id") * 37 % 1001) * 1.0).alias("v"))
    got = {(r.k, r.prob): r.quantile for r in N.group_quantiles(rows, ["k"], "v", [.1, .5, .975], F.floor(F.col("v") / 100)).collect()}
    for r in rows.groupBy("k").agg(F.percentile("v", F.array(F.lit(.1), F.lit(.5), F.lit(.975))).alias("q")).collect():
        assert [got[r.k, q] for q in (.1, .5, .975)] == pytest.approx(list(r.q))


def test_threshold(spark):
    clear = spark.createDataFrame([(i / 100, int(i >= 60)) for i in range(100)], "p double, event int")
    row = T.best_threshold(clear).first()
    assert 0.58 <= row.threshold <= 0.61 and row.hss > 0.95
    flat = spark.createDataFrame([(0.3, 1)] * 5, "p double, event int")
    assert T.best_threshold(flat).first().threshold == 0.5


@pytest.fixture(scope="module")
def samples(spark):
    from fcverify.fixtures import Views
    return Views(spark, "/root/testdata/sf0.001").samples


@pytest.mark.parametrize("rung,options", [
    ("linreg", {}), ("gbm", {"trees": 2, "depth": 2}), ("rf", {"trees": 5, "depth": 4}),
    ("mlp", {"trees": 2, "depth": 2, "hidden": (8,), "iterations": 15})])
def test_rungs(spark, samples, tmp_path, rung, options):
    parts = L.splits(samples, "2024-01-21", "2024-01-26")
    model = L.fit(parts["train"], parts["val"], rung, **options)
    out = model.predict(parts["test"])
    bad = out.filter("p_adverse is null or p_adverse < 0 or p_adverse > 1 or adverse is null or pred_vis_m is null")
    assert out.count() == parts["test"].count() and bad.isEmpty() and model.calibrator is not None
    if rung == "linreg":
        model.save(f"{tmp_path}/m")
        again = L.LadderModel.load(spark, f"{tmp_path}/m")
        keys = ["obs_id", "lead_h", "p_adverse", "adverse", "pred_wspd"]
        assert again.threshold == model.threshold and out.select(keys).exceptAll(again.predict(parts["test"]).select(keys)).isEmpty()
        prevailing = G.hours_from_predictions(out).filter("adverse <> (prevailing.flight_category in ('IFR', 'LIFR'))")
        assert prevailing.isEmpty()  # the decision rules the category


def test_stacks(spark):
    rows = spark.range(1200).select(
        F.col("id").alias("i"), F.element_at(F.array(*[F.lit(x) for x in (1, 2, 3, 6)]), (F.col("id") % 4 + 1).cast("int")).alias("lead_h"),
        (F.col("id") * 31 % 101 / 100).alias("a"), (F.col("id") * 17 % 97 / 96).alias("b"), F.lit(0.5).alias("c"))
    rows = rows.withColumn("event", (F.col("a") + 0.3 * F.col("b") > 0.8).cast("int"))
    val, test = rows.filter("i div 4 % 2 = 0"), rows.filter("i div 4 % 2 = 1")
    assert E.stack_report(E.Stack(["a", "b"]).fit(val), test).first().bss > 0.5
    assert E.stack_report(E.LeadStack(["a", "b"]).fit(val), test).first().bss > 0.3
    some = val.filter("lead_h <> 6 or i % 400 < 80")  # one lead has too few rows of its own
    stack = E.LeadStack(["a", "b"], min_rows=100).fit(some)
    assert 6 in stack.pooled and set(stack.models) == {1, 2, 3, None}
    for h in (1, 2, 3):  # each lead as if it were fitted alone, with a free intercept
        own = some.filter(F.col("lead_h") == h)
        alone = E.LeadStack(["a", "b"], min_rows=100)._regression(own, "event")
        assert stack.models[h][0] == pytest.approx(alone[0], abs=1e-6) and stack.models[h][1] == pytest.approx(alone[1], abs=1e-6)
        mean = stack._raw(own).agg(F.avg("p_raw"), F.avg("event")).first()
        assert mean[0] == pytest.approx(mean[1], abs=1e-3)
    ranked = [r.bases for r in E.ablation(val, test, ["a", "b", "c"]).collect()]
    assert len(ranked) == 7 and ranked[0].startswith("a") and E.subsets(["x"]) == [("x",)]
    report = E.blend_report(val, test, "a", "b").first()
    assert 0.5 <= report.w <= 1.0 and report.bss > 0
