"""Queries: aligned base probabilities, blends and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fcverify.catalog import register
from fcverify.catalog.verify import RATIOS, SKILL
from fcverify.catalog.scores import bss
from fcverify.fixtures import FIXTURE_VAL_END
from fcverify.functions import scoring as S
from fcverify.plans import ensemble as E
from fcverify.session import kept

BASES = ("p", "p2", "p_official")


def _parts(v):
    """Validation and test points by valid hour. Fits and reports pass over them many times, so they are scored once and kept."""
    late = F.col("valid_hour") >= F.lit(FIXTURE_VAL_END).cast("timestamp")
    points = kept(v.model_points.select(late.alias("late"), "lead_h", "event", *BASES))
    return points.filter(~F.col("late")), points.filter("late")


@register("aligned_probabilities", """select taf_id, valid_hour, round(p,6) as a, round(case when taf_id%3=0 then p else p2 end,6) as b,
 round(case when lead_h%5=0 then p else p_official end,6) as c from point_v""")
def aligned_probabilities(v):
    keys = ["taf_id", "valid_hour"]
    points = v.model_points.select(*keys)
    models = {"a": v.model_points.select(*keys, "p"),
              "b": v.model_points.filter("taf_id % 3 <> 0").select(*keys, F.col("p2").alias("p")),
              "c": v.model_points.filter("lead_h % 5 <> 0").select(*keys, F.col("p_official").alias("p"))}
    return E.align_probabilities(points, models, "a", keys)


@register("linear_blend", "select taf_id, valid_hour, round(0.6::double*p + 0.4::double*p2, 6) as p_blend from point_v")
def linear_blend(v):
    return E.blend(v.model_points, "p", "p2", F.lit(0.6)).select("taf_id", "valid_hour", "p_blend")


@register("fixed_blend_report", f"""select *, {RATIOS} from (select {bss('q', 'event')}, {SKILL} from (select *, case when q>=0.4 and event=1 then 'hit' when event=1 then 'miss'
 when q>=0.4 then 'false_alarm' else 'correct_neg' end as category_outcome from (select event, 0.6::double*p + 0.4::double*p2 as q from point_v)))""")
def fixed_blend_report(v):
    rows = E.blend(v.model_points, "p", "p2", F.lit(0.6))
    return E.binary_report(rows, "p_blend", "event", F.lit(0.4))


_LATE = f"valid_hour >= timestamp '{FIXTURE_VAL_END}'"
_CUTS = ", ".join(str((2 + i) / 100) for i in range(97))
_TUNED = {
    "weight_v": f"""select w from (select w, avg((w*p+(1-w)*p2-event)*(w*p+(1-w)*p2-event)) as brier from point_v,
  (select unnest(generate_series(0,20))/20.0::double as w) g where not ({_LATE}) group by 1) order by brier, w limit 1""",
    "tuned_v": "select event, valid_hour, w*p + (1-w)*p2 as q, w from point_v, weight_v",
    "tunedcand_v": f"select distinct unnest(c) as t from (select quantile_cont(q, [{_CUTS}]) as c from tuned_v where not ({_LATE}))",
    "tunedskill_v": f"""select t, count(*) filter (where q >= t and event = 1) as hits, count(*) filter (where q >= t and event = 0) as fa,
  count(*) filter (where q < t and event = 1) as miss, count(*) filter (where q < t and event = 0) as cn from tunedcand_v, tuned_v where not ({_LATE}) group by 1""",
    "tunedcut_v": """select t from (select t, case when (hits+miss)*(miss+cn)+(hits+fa)*(fa+cn) <> 0 then
  2.0::double*(hits*cn-miss*fa)/((hits+miss)*(miss+cn)+(hits+fa)*(fa+cn)) end as hss from tunedskill_v) order by hss desc, t limit 1""",
}


@register("blend_report", f"""select *, {RATIOS} from (select {bss('q', 'event')}, {SKILL}, round(any_value(w),6) as w, round(any_value(t),6) as threshold
 from (select *, case when q>=t and event=1 then 'hit' when event=1 then 'miss' when q>=t then 'false_alarm' else 'correct_neg' end as category_outcome
 from tuned_v, tunedcut_v where {_LATE}))""", _TUNED)
def blend_report(v):
    validation, test = _parts(v)
    return E.blend_report(validation, test, "p", "p2")


# A fit differs in its last digits from run to run; stated are the rows it is judged on, and that no base beats it by much.
_EVENTS = "count(*) as n, count(*) filter (where event = 1) as events"


def _judged(report, test):
    """n and events of a stack's report, and whether its skill is at most 0.05 below that of its best base."""
    best = test.agg(F.greatest(*[S.brier_skill(F.col(b), F.col("event")) for b in BASES]).alias("b")).scalar()
    return report.withColumn("_best", best).select(
        "n", (F.col("hits") + F.col("misses")).alias("events"), (F.col("bss") >= F.col("_best") - 0.05).alias("holds_up"))


@register("stack_eval", f"select {_EVENTS}, true as holds_up from point_v where {_LATE}")
def stack_eval(v):
    validation, test = _parts(v)
    return _judged(E.stack_report(E.Stack(BASES).fit(validation), test), test)


@register("lead_stack_eval", f"select {_EVENTS}, true as holds_up from point_v where {_LATE} and lead_h in (1, 2, 3, 6, 9, 12, 18, 24, 30)")
def lead_stack_eval(v):
    validation, test = _parts(v)
    test = test.filter(F.col("lead_h").isin(1, 2, 3, 6, 9, 12, 18, 24, 30))
    return _judged(E.stack_report(E.LeadStack(BASES).fit(validation), test), test)


@register("stack_ablation", f"""select unnest(['p', 'p2', 'p_official', 'p+p2', 'p+p_official', 'p2+p_official', 'p+p2+p_official']) as bases, n, true as in_range
 from (select {_EVENTS} from point_v where {_LATE})""")
def stack_ablation(v):
    validation, test = _parts(v)
    return E.ablation(validation, test, BASES).select("bases", "n", F.col("bss").between(-1, 1).alias("in_range"))
