"""Queries: skill tables and probability scores over scored hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from fcverify.catalog import register
from fcverify.catalog.verify import RATIOS, SKILL
from fcverify.fixtures import own_window_score
from fcverify.functions import scoring as S
from fcverify.operators import rollups as R
from fcverify.schema import CATEGORIES

EVENT = "case when obs_category in ('IFR','LIFR') then 1.0::double else 0.0 end"
BRIER = "avg(({p}-{e})*({p}-{e}))"
BSS = ("case when avg({e})*(1-avg({e})) > 0 then 1.0 - avg(({p}-{e})*({p}-{e}))/(avg({e})*(1-avg({e}))) end")
brier = lambda p="fcst_prob", e=EVENT: f"round({BRIER.format(p=p, e=e)}, 6) as brier"
bss = lambda p="fcst_prob", e=EVENT: f"round({BSS.format(p=p, e=e)}, 6) as bss"


@register("contingency", f"select n, hits, misses, false_alarms, correct_neg, {RATIOS} from (select {SKILL} from scored_v)")
def contingency(v):
    return R.contingency(v.scored)


@register("contingency_by_lead", f"select lead_time_h, n, hits, misses, false_alarms, correct_neg, {RATIOS} from (select lead_time_h, {SKILL} from scored_v group by 1)")
def contingency_by_lead(v):
    return R.contingency(v.scored, "lead_time_h")


@register("brier", f"select icao, {brier()} from scored_v group by 1")
def brier_query(v):
    return v.scored.groupBy("icao").agg(S.brier(F.col("fcst_prob"), R.observed_event()).alias("brier"))


@register("bss", f"select icao, {bss()} from scored_v group by 1")
def bss_query(v):
    return v.scored.groupBy("icao").agg(S.brier_skill(F.col("fcst_prob"), R.observed_event()).alias("bss"))


@register("bss_vs_reference", """select round(1 - avg((p-event)*(p-event))/avg((p_official-event)*(p_official-event)), 6) as bss,
 count(*) as n from point_v""")
def bss_vs_reference(v):
    return v.model_points.agg(S.brier_skill(F.col("p"), F.col("event"), F.col("p_official")).alias("bss"),
                              F.count(F.lit(1)).alias("n"))


@register("element_errors", """select icao, round(avg(abs(vis_err_m)),0) as vis_mae_m, round(avg(abs(ceiling_err_ft)),0) as ceiling_mae_ft,
 round(avg(abs(wind_err_kt)),1) as wind_mae_kt, round(avg(abs(dir_err_deg)),1) as dir_mae_deg,
 round(avg(weighted_score),3) as mean_weighted_score from scored_v group by 1""")
def element_errors(v):
    return R.element_errors(v.scored, "icao")


@register("lead_curve", """select icao, cast(floor(lead_time_h/6)*6 as integer) as lead_bucket, round(avg(weighted_score),3) as mean_score,
 count(*) as n from scored_v where lead_time_h >= 0 group by 1, 2""")
def lead_curve(v):
    return R.lead_curve(v.scored, "icao")


_COMPARE = f"""select *, {RATIOS} from (select {{by}}case when scoring_profile='categorical' then 'official' else scoring_profile end as profile,
 round(avg(weighted_score),6) as mean_weighted_score, {brier()}, {bss()}, {SKILL} from verif_v group by all)"""


@register("comparison", _COMPARE.format(by=""))
def comparison(v):
    return R.comparison(v.verification)


@register("comparison_ranked", """select icao, profile, row_number() over (partition by icao order by coalesce(bss,-1) desc, profile) as rank
 from (select icao, case when scoring_profile='categorical' then 'official' else scoring_profile end as profile, %s from verif_v group by all)""" % bss())
def comparison_ranked(v):
    return R.ranked_comparison(v.verification, "icao").select("icao", "profile", "rank")


_EVAL = f"""select lead_bucket, level, n, hits, misses, false_alarms, correct_neg, {RATIOS}, mean_weighted, vis_mae, ceiling_mae, wind_mae,
 (select count(*) from taf_v) as n_tafs from (select cast(floor(lead_time_h/6)*6 as integer) as lead_bucket, cast(grouping(cast(floor(lead_time_h/6)*6 as integer)) as integer) as level, {SKILL},
 round(avg(weighted_score),6) as mean_weighted, round(avg(abs(vis_err_m)),6) as vis_mae, round(avg(abs(ceiling_err_ft)),6) as ceiling_mae,
 round(avg(abs(wind_err_kt)),6) as wind_mae from scored_v group by grouping sets ((1),()))"""


@register("evaluation", _EVAL)
def evaluation(v):
    issued = v.taf.agg(F.count(F.lit(1)).alias("n")).scalar()
    return R.evaluation(v.scored, issued)


_OWN = {"wobs_v": "select * from obs_v", **own_window_score("own", "wobs_v", "date_trunc('hour', h.valid_from)", "ownhours_v"),
        "ownhours_v": "select * from expected_v where issued_at >= '2024-01-08' and issued_at < '2024-01-22'"}


@register("evaluate_window", _EVAL.replace("scored_v", "own_v").replace("(select count(*) from taf_v)", "(select count(distinct taf_id) from own_v)"), _OWN)
def evaluate_window(v):
    return R.evaluate_forecaster(v.taf, v.obs, v.groups, start="2024-01-08", end="2024-01-22")


@register("official_bss_window", f"select count(*) as n, {brier()}, {bss()} from scored_v where valid_hour >= timestamp '2024-01-26'")
def official_bss_window(v):
    return R.official_skill(v.verification, "2024-01-26")


@register("rollup_skill", f"""select *, {RATIOS} from (select region, icao, month, lead_bucket,
 cast(grouping(region)*8 + grouping(icao)*4 + grouping(month)*2 + grouping(lead_bucket) as integer) as level,
 {brier()}, {bss()}, {SKILL} from (select s.*, st.region, strftime(valid_hour, '%Y-%m') as month, cast(floor(lead_time_h/6)*6 as integer) as lead_bucket
  from scored_v s join station_v st on st.icao = s.icao) x group by rollup(region, icao, month, lead_bucket))""")
def rollup_skill(v):
    return R.skill_rollup(v.scored, v.stations)


@register("distinct_profiles", "select distinct icao, scoring_profile from verif_v")
def distinct_profiles(v):
    return v.verification.select("icao", "scoring_profile").distinct()


_EDGE = """case when {p} >= 0 and {p} < 0.05 then 0 when {p} >= 0.05 and {p} < 0.1 then 1 when {p} >= 0.1 and {p} < 0.2 then 2
 when {p} >= 0.2 and {p} < 0.3 then 3 when {p} >= 0.3 and {p} < 0.5 then 4 when {p} >= 0.5 and {p} < 0.7 then 5
 when {p} >= 0.7 and {p} < 1.01 then 6 end"""


@register("reliability", f"""select {_EDGE.format(p='p')} as bin, count(*) as n, round(avg(p),6) as mean_pred, round(avg(event),6) as obs_freq
 from point_v group by 1 having bin is not null""")
def reliability(v):
    return R.reliability(v.model_points)


@register("skill_by_lead", f"select lead_h, {bss('p', 'event')}, count(*) as n, round(avg(event),6) as rate from point_v where lead_h in (1,2,3,6,9,12,18,24,30) group by 1")
def skill_by_lead(v):
    return R.skill_by_lead(v.model_points)


@register("skill_by_region", f"""select region, {bss('p', 'event')}, count(*) as n, round(avg(event),6) as rate from point_v x
 join station_v s on s.icao = x.icao group by 1 having avg(event) > 0""")
def skill_by_region(v):
    return R.skill_by_region(v.model_points.join(v.stations.select("icao", "region"), "icao"))


@register("target_moments", """select round(avg(vis_m),6) as vis_m_mean, round(stddev_pop(vis_m),6) as vis_m_std,
 round(avg(wind_spd_kt),6) as wind_spd_kt_mean, round(stddev_pop(wind_spd_kt),6) as wind_spd_kt_std from obs_v where ceiling_ft is not null""")
def target_moments(v):
    return R.masked_moments(v.obs, ["vis_m", "wind_spd_kt"], F.col("ceiling_ft").isNotNull())


@register("class_weights", """select c as flight_category, count(o.obs_id) as n, round((select count(*) from obs_v where flight_category is not null)
 / (4.0::double * greatest(count(o.obs_id), 1)), 6) as weight from (select unnest(['LIFR','IFR','MVFR','VFR']) as c) k
 left join obs_v o on o.flight_category = c group by 1""")
def class_weights(v):
    return R.class_weights(v.obs, "flight_category", CATEGORIES)


@register("pinball", """select round(sum(greatest(0.1*(o-0.5*f), -0.9*(o-0.5*f)) + greatest(0.5*(o-f), -0.5*(o-f)) + greatest(0.9*(o-1.5*f), -0.1*(o-1.5*f)))
 / greatest(count(*), 1), 6) as pinball from (select e.p_vis as f, b.vis_m as o from expected_v e
 join best_v b on b.icao = e.icao and b.valid_hour = e.valid_hour where b.flight_category is not null and e.p_vis is not null)""")
def pinball(v):
    f = F.col("prevailing.vis_m")
    rows = v.aligned.filter(f.isNotNull()).select(
        F.col("obs.vis_m").alias("y"), (f * 0.5).alias("q10"), f.alias("q50"), (f * 1.5).alias("q90"),
        F.col("obs.flight_category").isNotNull().alias("known"))
    return R.pinball_loss(rows, "y", {0.1: "q10", 0.5: "q50", 0.9: "q90"}, F.col("known"))


@register("element_mae", "select round(avg(abs(vis_err_m)),6) as vis, round(avg(abs(ceiling_err_ft)),6) as ceiling, round(avg(abs(wind_err_kt)),6) as wind from scored_v")
def element_mae(v):
    return v.scored.agg(F.avg(F.abs("vis_err_m")).alias("vis"), F.avg(F.abs("ceiling_err_ft")).alias("ceiling"),
                        F.avg(F.abs("wind_err_kt")).alias("wind"))
