"""Queries: thresholds, gate, generated forecasts, ladder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fcverify.catalog import register, rounded
from fcverify.catalog.feature_frames import FRAME
from fcverify.catalog.scores import bss
from fcverify.catalog.verify import RATIOS, SKILL
from fcverify.fixtures import FIXTURE_TRAIN_END, FIXTURE_VAL_END, own_window_score
from fcverify.functions import scoring as S
from fcverify.functions.conditions import flight_category
from fcverify.operators import bootstrap as B
from fcverify.operators import draws as W
from fcverify.operators import forecasters as FC
from fcverify.operators import probgroups as G
from fcverify.operators import thresholds as T
from fcverify.operators.verification import score_own_window, score_profile
from fcverify.plans import gate as gate_plan
from fcverify.plans import ladder
from fcverify.session import checkpoint_folder
from fcverify.sources import tables

# --- thresholds -------------------------------------------------------------

_PROBS = ", ".join(str((2 + i) / 100) for i in range(97))
CAND = {
    "cand_v": f"select distinct unnest(q) as t from (select quantile_cont(p, [{_PROBS}]) as q from point_v)",
    "candskill_v": """select t, count(*) filter (where p >= t and event = 1) as hits, count(*) filter (where p >= t and event = 0) as fa,
  count(*) filter (where p < t and event = 1) as miss, count(*) filter (where p < t and event = 0) as cn from cand_v, point_v group by 1""",
    "candhss_v": """select *, case when (hits+miss)*(miss+cn)+(hits+fa)*(fa+cn) <> 0 then
  2.0::double*(hits*cn-miss*fa)/((hits+miss)*(miss+cn)+(hits+fa)*(fa+cn)) end as hss from candskill_v""",
}


@register("probability_quantiles", f"select unnest([{_PROBS}])::double as prob, round(unnest(q),6) as quantile from (select quantile_cont(p, [{_PROBS}]) as q from point_v)")
def probability_quantiles(v):
    return T.probability_quantiles(v.model_points, "p", T.CANDIDATE_QUANTILES)


@register("threshold_candidates", "select round(t,6) as threshold, cast(hits as bigint) as hits, cast(fa as bigint) as false_alarms, cast(miss as bigint) as misses, "
          "cast(cn as bigint) as correct_neg, round(hss,6) as hss from candhss_v", CAND)
def threshold_candidates(v):
    return T.candidate_skill(v.model_points)


@register("threshold_search", "select round(t,6) as threshold, round(hss,6) as hss from candhss_v order by hss desc, t limit 1", CAND)
def threshold_search(v):
    return T.best_threshold(v.model_points)


@register("blend_grid", """select round(w,6) as w, round(avg((w*p+(1-w)*p2-event)*(w*p+(1-w)*p2-event)),6) as brier
 from point_v, (select unnest(generate_series(0,20))/20.0::double as w) g group by 1""")
def blend_grid(v):
    return T.blend_weights(v.model_points, "p", "p2")


@register("blend_best", """select round(w,6) as w, round(brier,6) as brier from (select w, avg((w*p+(1-w)*p2-event)*(w*p+(1-w)*p2-event)) as brier
 from point_v, (select unnest(generate_series(0,20))/20.0::double as w) g group by 1) order by brier, w limit 1""")
def blend_best(v):
    return T.best_blend(v.model_points, "p", "p2")


@register("decision_at_threshold", """select n, hits, misses, false_alarms, correct_neg, %s from (select %s from (select case when p>=0.45 and event=1 then 'hit'
 when p<0.45 and event=1 then 'miss' when p>=0.45 then 'false_alarm' else 'correct_neg' end as category_outcome from point_v))""" % (RATIOS, SKILL))
def decision_at_threshold(v):
    outcome = S.outcome(F.col("p") >= 0.45, F.col("event") == 1).alias("category_outcome")
    return v.model_points.select(outcome).agg(*S.outcome_counts()).withColumns(S.skill_ratios())


# --- gate -------------------------------------------------------------------

GATE = {
    "champ_v": "select * from verif_v where scoring_profile = 'categorical'",
    "chal_v": "select * from verif_v where scoring_profile = 'persistence'",
    "pair_v": """select a.taf_id, a.icao, a.valid_hour, a.category_outcome as champion, b.category_outcome as challenger, a.fcst_prob as p_champion,
  b.fcst_prob as p_challenger, case when a.obs_category in ('IFR','LIFR') then 1 else 0 end as event
  from champ_v a join chal_v b on b.taf_id = a.taf_id and b.valid_hour = a.valid_hour""",
}


def _pairs(v):
    return gate_plan.pair(v.scored, score_profile(v.taf, v.obs, v.groups, "persistence"))


@register("paired_eval", "select taf_id, icao, valid_hour, champion, challenger, event, round(p_champion,6) as p_champion, round(p_challenger,6) as p_challenger from pair_v", GATE)
def paired_eval(v):
    return _pairs(v)


@register("pair_cells", """select a.o as champion, b.o as challenger, count(p.taf_id) as n
 from (select unnest(['hit','miss','false_alarm','correct_neg']) as o) a, (select unnest(['hit','miss','false_alarm','correct_neg']) as o) b
 left join pair_v p on p.champion = a.o and p.challenger = b.o group by 1, 2""", GATE)
def pair_cells(v):
    cells = B.pair_cells(_pairs(v)).select(F.posexplode("cells").alias("i", "n"))
    name = lambda i: F.element_at(F.array(*[F.lit(o) for o in B.OUTCOMES]), (i + 1).cast("int"))
    return cells.select(name(F.floor(F.col("i") / 4)).alias("champion"), name(F.col("i") % 4).alias("challenger"), "n")


_H = "2.0::double*({h}*{c}-{m}*{f})/(({h}+{m})*({m}+{c})+({h}+{f})*({f}+{c}))"
_POINT = """select n as n_paired, round(%s,6) as champion_hss, round(%s,6) as challenger_hss, round(champion_bss,6) as champion_bss,
 round(challenger_bss,6) as challenger_bss, round(%s - %s,6) as hss_diff from (select count(*) as n,
 %s, %s, %s, %s from pair_v)""" % (
    _H.format(h="ah", m="am", f="af", c="ac"), _H.format(h="bh", m="bm", f="bf", c="bc"),
    _H.format(h="bh", m="bm", f="bf", c="bc"), _H.format(h="ah", m="am", f="af", c="ac"),
    ", ".join(f"count(*) filter (where champion='{o}') as a{k}" for o, k in zip(B.OUTCOMES, "hmfc")),
    ", ".join(f"count(*) filter (where challenger='{o}') as b{k}" for o, k in zip(B.OUTCOMES, "hmfc")),
    bss("p_champion", "event").replace("round(", "(").replace(", 6) as bss", ") as champion_bss"),
    bss("p_challenger", "event").replace("round(", "(").replace(", 6) as bss", ") as challenger_bss"))


def _mix(name: str, source: str, x: str, keep: str) -> dict[str, str]:
    """Views that mix the number ``x`` of the rows of ``source`` to 32 bits ``h``, one step a view."""
    half = f"(xor(x >> 16, x) * {W.MULTIPLIER}) % 4294967296"
    return {f"{name}one_v": f"select {keep}, {x} as x from {source}", f"{name}two_v": f"select {keep}, {half} as x from {name}one_v",
            f"{name}three_v": f"select {keep}, {half} as x from {name}two_v", f"{name}mix_v": f"select {keep}, xor(x >> 16, x) as h from {name}three_v"}


def _drawn(name: str, cells: str, number: str, keep: str, n_boot: int) -> dict[str, str]:
    """Views with a Poisson weight ``w`` for each cell (``n``, ``number``) of ``cells`` and replicate; ``keep`` names the cells' columns."""
    return {
        "pois_v": f"""select n, list(c order by k) as c from (select n, k, sum(p) over (partition by n order by k) as c from (
 select n, k, exp(-n + k * ln(n) - lf) as p from (select unnest(range(1, {W.EXACT + 1})) as n) a, (select k, sum(case when k = 0 then 0.0::double
 else ln(k) end) over (order by k) as lf from (select unnest(range(0, 141)) as k)) b)) where k <= cast(floor(n + 8 * sqrt(n) + 12) as bigint) group by n""",
        f"{name}rep_v": f"select {keep}, rep, j, {number} as cell from {cells}, (select unnest(range(0, {n_boot})) as rep) r, (select unnest([0, 1]) as j) s",
        **_mix(name, f"{name}rep_v", f"((cell * {W.CELL_STEP} + rep) * 2 + j) % 4294967296", f"{keep}, rep, j, cell"),
        f"{name}uni_v": f"""select {keep}, rep, max(case when j = 0 then (h + 0.5::double) / 4294967296 end) as u,
 max(case when j = 1 then (h + 0.5::double) / 4294967296 end) as v from {name}mix_v group by all""",
        f"{name}z_v": f"select *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) as z from {name}uni_v",
        f"{name}w_v": f"""select x.*, case when x.n <= 0 then 0.0::double when x.n <= {W.EXACT} then cast(len(list_filter(p.c, lambda e: e <= x.u)) as double)
 else greatest(0.0::double, floor(x.n + sqrt(x.n) * z + (z * z - 1) / 6 + 0.5::double)) end as w from {name}z_v x left join pois_v p on p.n = x.n""",
    }


_SIDE = ", ".join(f"sum(case when {e} = {k} then w else 0 end) as {s}{k}" for s, e in (("a", "i // 4"), ("b", "i % 4")) for k in range(4))
_SKILL_OF = "2.0::double*({0}0*{0}3-{0}1*{0}2)/nullif(({0}0+{0}1)*({0}1+{0}3)+({0}0+{0}2)*({0}2+{0}3), 0)"
_NAMES = "(select unnest(['hit','miss','false_alarm','correct_neg']) as o, unnest([0,1,2,3]) as k)"
HSS_DRAWN = {
    **GATE,
    "cells_v": f"""select a.k * 4 + b.k as i, count(p.taf_id) as n from {_NAMES} a, {_NAMES} b left join pair_v p on p.champion = a.o and p.challenger = b.o
 group by 1""",
    **_drawn("hss", "cells_v", "i", "i, n", B.HSS_REPLICATES),
    "hssdiff_v": f"select {_SKILL_OF.format('b')} - {_SKILL_OF.format('a')} as d from (select rep, {_SIDE} from hssw_v group by rep)",
    "hssends_v": """select list_extract(d, cast(floor(len(d) * 0.025::double) as bigint) + 1) as ci_low,
 list_extract(d, cast(floor(len(d) * 0.975::double) as bigint) + 1) as ci_high from (select list(d order by d) as d from hssdiff_v where d is not null)""",
}
_ENDS = "round(ci_low,6) as ci_low, round(ci_high,6) as ci_high, coalesce(ci_low > 0, false) as {}"


@register("gate_point", "select * from (" + _POINT + "), (select " + _ENDS.format("wins") + " from hssends_v)", HSS_DRAWN)
def gate_point(v):
    return gate_plan.decide(_pairs(v), "persistence").select(
        "n_paired", "champion_hss", "challenger_hss", "champion_bss", "challenger_bss", "hss_diff", "ci_low", "ci_high", F.col("promote").alias("wins"))


@register("bootstrap_hss", "select n_paired as n, champion_hss, challenger_hss, hss_diff as diff, " + _ENDS.format("wins") + " from (" + _POINT + "), hssends_v", HSS_DRAWN)
def bootstrap_hss(v):
    return B.bootstrap_hss(_pairs(v)).select("n", "champion_hss", "challenger_hss", "diff", "ci_low", "ci_high", "wins")


BSS_DRAWN = {
    "errs_v": "select (p - event) * (p - event) as err, cast(event as bigint) as event, count(*) as n from point_v group by 1, 2",
    **_drawn("bss", "errs_v", "(cast(floor(err * 1e9::double) as bigint) * 2 + event) % 4294967296", "err, event, n", B.BSS_REPLICATES),
    "bssboot_v": """select 1 - mean / (r - r * r) as b from (select rep, sum(w * err) / sum(w) as mean from bssw_v group by rep),
 (select avg(event) as r from point_v)""",
}


@register("bootstrap_bss", "select %s, round(low,6) as low, round(high,6) as high, any_value(low) > 0 as wins from point_v, (select quantile_cont(b, 0.025) as low, "
          "quantile_cont(b, 0.975) as high from bssboot_v) group by low, high" % bss("p", "event"), BSS_DRAWN)
def bootstrap_bss(v):
    ends = B.bootstrap_bss(v.model_points, few_values=True).select(F.struct("*").alias("e"))
    point = v.model_points.agg(S.brier_skill(F.col("p"), F.col("event")).alias("bss")).withColumn("e", ends.scalar())
    return point.select("bss", "e.low", "e.high", "e.wins")


@register("gate_decision", "select 'promotion_gate' as kind, 'persistence' as challenger, 'official' as champion, g.*, " + _ENDS.format("promote") + " from (" + _POINT
          + ") g, hssends_v", HSS_DRAWN)
def gate_decision(v):
    return gate_plan.decide(_pairs(v), "persistence").select(
        "kind", "challenger", "champion", "n_paired", "champion_hss", "challenger_hss", "champion_bss", "challenger_bss", "hss_diff",
        "ci_low", "ci_high", "promote")


@register("champion_line", "select 'gbm' as rung, 'models/c' as model_path, 'official' as beat, challenger_hss as test_hss, n_paired, 3 as records, 3 as logged from ("
          + _POINT + ")", HSS_DRAWN)
def champion_line(v):
    """Two promotions at once against the official forecast, then one against their winner and a late one: who is champion."""
    root = f"{checkpoint_folder(v.spark)}/registry-{uuid.uuid4().hex}"
    made = gate_plan.decide(_pairs(v), "persistence").collect()
    decision = v.spark.createDataFrame(made, "kind string, challenger string, champion string, n_paired long, champion_hss double, challenger_hss double, "
                                       "champion_bss double, challenger_bss double, hss_diff double, ci_low double, ci_high double, promote boolean")
    promote = lambda rung, name, base: (tables.log_experiment(decision, f"{root}/log", "promotion_gate"),
                                        tables.save_champion(decision, f"{root}/champion", rung, f"models/{name}", base))[1]
    first = promote("linreg", "a", None)
    promote("rf", "b", None)
    promote("gbm", "c", first)
    count = lambda df: df.agg(F.count(F.lit(1)).cast("int")).scalar()
    records = v.spark.read.schema(tables.CHAMPION_SCHEMA).json(f"{root}/champion")
    return tables.load_champion(v.spark, f"{root}/champion").select(
        "rung", "model_path", "beat", "test_hss", "n_paired", count(records).alias("records"), count(tables.read_log(v.spark, f"{root}/log")).alias("logged"))


OWN = {"gobs_v": "select * from obs_v where observed_at >= '2024-01-10' and observed_at < '2024-01-20'",
       **own_window_score("gate", "gobs_v", "h.valid_from", "gatehours_v"),
       "gatehours_v": "select * from expected_v where issued_at >= '2024-01-10' and issued_at < '2024-01-20'"}


@register("gate_window_scores", "select taf_id, valid_hour, category_outcome, obs_category, " + rounded("fcst_prob", "vis_err_m", "weighted_score") + " from gate_v", OWN)
def gate_window_scores(v):
    rows = gate_plan.score_in_window(v.taf, v.obs, v.groups, FC.official, "2024-01-10", "2024-01-20")
    return rows.select("taf_id", "valid_hour", "category_outcome", "obs_category", "fcst_prob", "vis_err_m", "weighted_score")


@register("runner_scores", "select taf_id, valid_hour, category_outcome, obs_category, " + rounded("fcst_prob", "vis_err_m", "weighted_score") + " from runner_v",
          own_window_score("runner", "obs_v", "date_trunc('hour', h.valid_from)", "expected_v"))
def runner_scores(v):
    return score_own_window(v.taf, v.obs, v.groups).select(
        "taf_id", "valid_hour", "category_outcome", "obs_category", "fcst_prob", "vis_err_m", "weighted_score")


# --- generated forecasts ----------------------------------------------------

_BUCKET = """case when abs({p}-0) <= least(abs({p}-0.3), abs({p}-0.4), abs({p}-1)) then 0 when abs({p}-0.3) <= least(abs({p}-0.4), abs({p}-1)) then 1
 when abs({p}-0.4) <= abs({p}-1) then 2 else 3 end"""


@register("quantise", f"""select taf_id, valid_hour, {_BUCKET.format(p='p')} = 3 as commit, case {_BUCKET.format(p='p')} when 1 then 'PROB30' when 2 then 'PROB40' end as group_type,
 round(case {_BUCKET.format(p='p')} when 0 then 0 when 1 then 0.3::double when 2 then 0.4 else 1 end, 6) as group_probability from point_v""")
def quantise(v):
    return v.model_points.select("taf_id", "valid_hour", *[c.alias(n) for n, c in G.quantised(F.col("p")).items()])


def _vectors(v):
    """Formula quantiles per scored hour: a bad case at half the median."""
    base = (F.col("taf_id") * 31 + F.col("lead_h") * 17) % 100
    vis, ceil = base * 100.0 - 50, base * 50.0
    vector = lambda k: F.struct((vis * k).alias("vis"), (ceil * k).alias("ceiling"), (base % 30 - 2.0).alias("wspd"),
                                ((base % 3) - 1.0).alias("wdir_sin"), ((base % 2) * 1.0).alias("wdir_cos"))
    return v.model_points.withColumns({"q10": vector(0.5), "q50": vector(1.0), "p_adverse": F.col("p")})


_CATV = ("case when {c} < 500 or {v} < 1600 then 'LIFR' when {c} < 1000 or {v} < 4800 then 'IFR' when {c} < 3000 or {v} < 8000 then 'MVFR' else 'VFR' end")
GEN = {
    "gen_v": f"""select *, greatest(0, b*100.0-50) as v50, b*50.0 as c50, greatest(0, (b*100.0-50)*0.5) as v10, b*25.0 as c10, {_BUCKET.format(p='p')} as bucket
  from (select *, (taf_id*31+lead_h*17)%100 as b from point_v)""",
    "gencat_v": f"select *, {_CATV.format(c='c50', v='v50')} as cat50, case when {_CATV.format(c='c10', v='v10')} = 'LIFR' then 'LIFR' else 'IFR' end as bad from gen_v",
    "genout_v": """select taf_id, valid_hour, event, p, case when bucket=3 then bad else cat50 end as category,
  cast(case when bucket=3 then least(v10, case bad when 'LIFR' then 700 else 2500 end) else v50 end as double) as vis_m,
  cast(case when bucket=3 then least(c10, case bad when 'LIFR' then 200 else 600 end) else c50 end as double) as ceiling_ft,
  case bucket when 1 then 'PROB30' when 2 then 'PROB40' end as group_type, case bucket when 1 then 30 when 2 then 40 end as percent,
  case when bucket in (1,2) then bad end as prob_category,
  cast(case when bucket in (1,2) then least(v10, case bad when 'LIFR' then 700 else 2500 end) end as double) as prob_vis,
  cast(case when b%3-1=0 and b%2=0 then null when degrees(atan2(b%3-1.0, b%2)) < 0 then degrees(atan2(b%3-1.0, b%2))+360 else degrees(atan2(b%3-1.0, b%2)) end as double) as wind_dir
  from gencat_v""",
}


@register("prob_groups", "select taf_id, valid_hour, category, group_type, percent, prob_category, " + rounded("vis_m", "ceiling_ft", "prob_vis", "wind_dir") + " from genout_v", GEN)
def prob_groups(v):
    rows = G.hours_from_quantiles(_vectors(v))
    return rows.select("taf_id", "valid_hour", F.col("prevailing.flight_category").alias("category"), "group_type",
                       F.col("prob.probability").alias("percent"), F.col("prob.flight_category").alias("prob_category"),
                       "prevailing.vis_m", "prevailing.ceiling_ft", F.col("prob.vis_m").alias("prob_vis"),
                       F.col("prevailing.wind_dir_deg").alias("wind_dir"))


@register("generated_score", """select round(%s,6) as bss_generated, round(%s,6) as bss_continuous, count(*) as n from (select *, case when category in ('IFR','LIFR') then 1.0
 when percent is not null then percent/100.0::double else 0.0 end as g from genout_v)""" % (
    bss("g", "event").replace("round(", "(").replace(", 6) as bss", ")"), bss("p", "event").replace("round(", "(").replace(", 6) as bss", ")")), GEN)
def generated_score(v):
    rows = G.hours_from_quantiles(_vectors(v))
    stated = S.adverse_probability(F.col("prevailing"), F.col("tempo"), F.col("prob"))
    return rows.agg(S.brier_skill(stated, F.col("event")).alias("bss_generated"),
                    S.brier_skill(F.col("p"), F.col("event")).alias("bss_continuous"), F.count(F.lit(1)).alias("n"))


@register("horizon_hours", """select taf_id, lead_h, issued_at + to_hours(lead_h) as valid_hour, round(((taf_id+lead_h-1)%10)/10.0::double,6) as p_adverse, round((taf_id%50)*100.0::double+(lead_h-1),6) as q10_vis
 from taf_v, (select cast(unnest(generate_series(1,30)) as integer) as lead_h) l""")
def horizon_hours(v):
    steps = F.sequence(F.lit(0), F.lit(29))
    vector = lambda k, add: F.struct((F.col("taf_id") % 50 * 100.0 + k + add).alias("vis"))
    issues = v.taf.select("taf_id", F.col("issued_at").alias("t0"),
                          F.transform(steps, lambda k: F.struct(vector(k, 0).alias("q10"), vector(k, 1).alias("q50"))).alias("quantiles"),
                          F.transform(steps, lambda k: ((F.col("taf_id") + k) % 10) / 10.0).alias("p_adverse"))
    return G.expand_horizons(issues).select("taf_id", "lead_h", "valid_hour", "p_adverse", F.col("q10.vis").alias("q10_vis"))


@register("model_hours", """select taf_id, valid_hour, case when adverse then case when d in ('IFR','LIFR') then d else 'IFR' end
 when d in ('IFR','LIFR') then 'MVFR' else d end as category, round(vis,6) as vis_m, round(ceil,6) as ceiling_ft from (select *, %s as d from (select taf_id, valid_hour,
 greatest(0.0::double, ((taf_id*31+lead_h*17)%%100)*100.0::double-500) as vis, case when (taf_id%%10)/10.0 >= 0.5 then ((taf_id*31+lead_h*17)%%100)*50.0::double end as ceil, p >= 0.5 as adverse from point_v))"""
          % "case when ceil < 500 or vis < 1600 then 'LIFR' when ceil < 1000 or vis < 4800 then 'IFR' when ceil < 3000 or vis < 8000 then 'MVFR' else 'VFR' end")
def model_hours(v):
    base = (F.col("taf_id") * 31 + F.col("lead_h") * 17) % 100
    preds = v.model_points.withColumns({
        "pred_vis_m": base * 100.0 - 500, "pred_ceiling_ft": base * 50.0, "pred_has_ceiling": (F.col("taf_id") % 10) / 10.0,
        "pred_wspd": base - 5.0, "pred_wdir_sin": F.lit(0.0), "pred_wdir_cos": F.lit(1.0), "adverse": F.col("p") >= 0.5})
    return G.hours_from_predictions(preds).select(
        "taf_id", "valid_hour", F.col("prevailing.flight_category").alias("category"), "prevailing.vis_m", "prevailing.ceiling_ft")


@register("forced_adverse", """select obs_id, case when flight_category in ('IFR','LIFR') then flight_category else 'IFR' end as category,
 round(least(vis_m, case when flight_category='LIFR' then 700 else 2500 end),6) as vis_m,
 round(least(coalesce(cast(ceiling_ft as double), 1e9), case when flight_category='LIFR' then 200 else 600 end),6) as ceiling_ft from obs_v""")
def forced_adverse(v):
    from fcverify.functions.conditions import state
    s = v.obs.select("obs_id", state(flight_category=flight_category(F.col("ceiling_ft"), F.col("vis_m"))).alias("s"))
    forced = G.forced_adverse(F.col("s"))
    return s.select("obs_id", forced.alias("f")).select(
        "obs_id", F.col("f.flight_category").alias("category"), "f.vis_m", "f.ceiling_ft")


# --- ladder -----------------------------------------------------------------

def _held(low: str, value: str, high: str):
    return (F.col(low) <= F.col(value)) & (F.col(value) <= F.col(high))


# A fit differs in its last digits from run to run; stated are the events it is judged on, and that its scores are in range.
@register("ladder_eval", f"""select 'linreg' as rung, split, count(*) filter (where y_cat in ('IFR','LIFR')) as events, true as in_range, true as in_interval
 from (select y_cat, case when t0 < timestamp '{FIXTURE_TRAIN_END}' then 'train' when t0 < timestamp '{FIXTURE_VAL_END}' then 'val' else 'test' end as split
 from frame_v) where split <> 'train' group by split""", FRAME)
def ladder_eval(v):
    """The linear rung on the sample frame: validation and test metrics."""
    _, table = ladder.train_and_evaluate(v.samples, "linreg", FIXTURE_TRAIN_END, FIXTURE_VAL_END)
    return table.select("rung", "split", (F.col("hits") + F.col("misses")).alias("events"), F.col("bss").between(-1, 1).alias("in_range"),
                        _held("bss_low", "bss", "bss_high").alias("in_interval"))
