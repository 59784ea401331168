"""Queries: causal features, samples, splits, sequence windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fcverify.catalog import register, rounded
from fcverify.fixtures import FIXTURE_TRAIN_END, FIXTURE_VAL_END
from fcverify.functions import sampling as P
from fcverify.functions.conditions import day_cycle, sin_cos_known
from fcverify.functions.timetokens import hour_boundaries
from fcverify.operators import features as X
from fcverify.operators import sequences as Q
from fcverify.schema import LAGS_H, LEADS_H

_NWP = ("wind10m_spd", "wind10m_dir", "gust", "t2m_c", "d2m_c", "tcc", "cbh_m", "tp_mm", "mslp_hpa")


def _features_sql(grid: str, keys: str, targets: bool) -> str:
    """Feature rows in SQL over a grid with icao, t0, valid_time, lead_h."""
    joins = " ".join(f"asof left join obs_v a{h} on a{h}.icao = g.icao and a{h}.observed_at <= g.t0 - interval {h} hour"
                     for h in (0, *LAGS_H))
    spread = lambda a: f"({a}.temp_c - {a}.dewpoint_c)"
    ceil = lambda c: f"coalesce({c}, 30000)"
    cols = {
        "f_o0_vis": "a0.vis_m", "f_o0_ceiling": ceil("a0.ceiling_ft"), "f_o0_has_ceiling": "case when a0.ceiling_ft is null then 0 else 1 end",
        "f_o0_wspd": "a0.wind_spd_kt", "f_o0_spread": spread("a0"), "f_o0_temp": "a0.temp_c",
        "f_o0_wdir_sin": "coalesce(sin(radians(a0.wind_dir_deg)),0)", "f_o0_wdir_cos": "coalesce(cos(radians(a0.wind_dir_deg)),0)",
        "f_o0_wdir_known": "case when a0.wind_dir_deg is null then 0 else 1 end"}
    for h in LAGS_H:
        a = f"a{h}"
        cols.update({f"f_o{h}_vis": f"{a}.vis_m", f"f_o{h}_ceiling": ceil(f"{a}.ceiling_ft"), f"f_o{h}_spread": spread(a),
                     f"f_dvis_{h}": f"a0.vis_m - {a}.vis_m", f"f_dceil_{h}": f"{ceil('a0.ceiling_ft')} - {ceil(a + '.ceiling_ft')}",
                     f"f_dspread_{h}": f"{spread('a0')} - {spread(a)}", f"f_dwspd_{h}": f"a0.wind_spd_kt - {a}.wind_spd_kt"})
    cols.update({
        "f_et_wspd": "et.wind10m_spd", "f_et_gust": "et.gust", "f_et_t2m": "et.t2m_c", "f_et_spread": "et.t2m_c - et.d2m_c",
        "f_et_tcc": "et.tcc", "f_et_cbh": "et.cbh_m", "f_et_tp": "et.tp_mm", "f_et_msl": "et.mslp_hpa",
        "f_et_wdir_sin": "coalesce(sin(radians(et.wind10m_dir)),0)", "f_et_wdir_cos": "coalesce(cos(radians(et.wind10m_dir)),0)",
        "f_et_wdir_known": "case when et.wind10m_dir is null then 0 else 1 end",
        "f_tend_t2m": "et.t2m_c - e0.t2m_c", "f_tend_spread": "(et.t2m_c - et.d2m_c) - (e0.t2m_c - e0.d2m_c)",
        "f_tend_tcc": "et.tcc - e0.tcc", "f_tend_msl": "et.mslp_hpa - e0.mslp_hpa", "f_tend_wspd": "et.wind10m_spd - e0.wind10m_spd",
        "f_lead_h": "g.lead_h", "f_hod_sin": "sin(2*pi()*hour(g.valid_time)/24)", "f_hod_cos": "cos(2*pi()*hour(g.valid_time)/24)",
        "f_doy_sin": "sin(2*pi()*dayofyear(g.valid_time)/365)", "f_doy_cos": "cos(2*pi()*dayofyear(g.valid_time)/365)",
        "f_elevation": "s.elevation_m", "f_lat": "s.lat", "f_lon": "s.lon"})
    if targets:
        cols.update({"y_vis_m": "g.vis_m", "y_ceiling_ft": ceil("g.ceiling_ft"), "y_has_ceiling": "case when g.ceiling_ft is null then 0 else 1 end",
                     "y_wspd": "g.wind_spd_kt", "y_wdir_sin": "coalesce(sin(radians(g.wind_dir_deg)),0)",
                     "y_wdir_cos": "coalesce(cos(radians(g.wind_dir_deg)),0)", "y_wdir_known": "case when g.wind_dir_deg is null then 0 else 1 end"})
    body = ", ".join(f"cast({e} as double) as {n}" for n, e in cols.items())
    if targets:
        body += ", g.flight_category as y_cat"
    return f"""select {keys}, s.region, a0.observed_at as o0_time, {body} from {grid} g {joins}
 left join nwp_v et on et.icao = g.icao and et.source = 'era5' and et.valid_time = date_trunc('hour', g.valid_time)
 left join nwp_v e0 on e0.icao = g.icao and e0.source = 'era5' and e0.valid_time = date_trunc('hour', g.t0)
 join station_v s on s.icao = g.icao where a0.observed_at is not null and date_diff('microsecond', a0.observed_at, g.t0) <= 21600000000"""


LEADGRID = f"""select o.*, o.observed_at as valid_time, h as lead_h, o.observed_at - to_hours(h) as t0 from obs_v o,
 (select unnest([{', '.join(map(str, LEADS_H))}]) as h) l"""
FRAME = {"leadgrid_v": LEADGRID, "frame_v": _features_sql("leadgrid_v", "g.obs_id, g.icao, g.t0, g.valid_time, g.lead_h", True)}

NUMERIC = ["f_o0_vis", "f_o0_ceiling", "f_o0_has_ceiling", "f_o0_wspd", "f_o0_spread", "f_o0_temp", "f_o0_wdir_sin",
           "f_o0_wdir_cos", "f_o0_wdir_known",
           *[f.format(h) for h in LAGS_H for f in ("f_o{}_vis", "f_o{}_ceiling", "f_o{}_spread", "f_dvis_{}", "f_dceil_{}",
                                                  "f_dspread_{}", "f_dwspd_{}")],
           "f_et_wspd", "f_et_gust", "f_et_t2m", "f_et_spread", "f_et_tcc", "f_et_cbh", "f_et_tp", "f_et_msl", "f_et_wdir_sin",
           "f_et_wdir_cos", "f_et_wdir_known", "f_tend_t2m", "f_tend_spread", "f_tend_tcc", "f_tend_msl", "f_tend_wspd",
           "f_lead_h", "f_hod_sin", "f_hod_cos", "f_doy_sin", "f_doy_cos", "f_elevation", "f_lat", "f_lon"]
TARGETS = ["y_vis_m", "y_ceiling_ft", "y_has_ceiling", "y_wspd", "y_wdir_sin", "y_wdir_cos", "y_wdir_known"]
_SHOW = ["f_o0_vis", "f_o1_vis", "f_o6_ceiling", "f_dspread_3", "f_et_t2m", "f_tend_msl", "f_hod_sin", "y_ceiling_ft", "y_wdir_cos"]


@register("causal_features", "select obs_id, icao, region, t0, valid_time, lead_h, o0_time, y_cat, " + rounded(*_SHOW) + " from frame_v", FRAME)
def causal_features(v):
    return v.samples.select("obs_id", "icao", "region", "t0", "valid_time", "lead_h", "o0_time", "y_cat",
                            *[F.col(c).cast("double").alias(c) for c in _SHOW])


@register("feature_means", "select icao, lead_h, count(*) as n, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in NUMERIC + TARGETS)
          + " from frame_v group by 1, 2", FRAME)
def feature_means(v):
    return v.samples.groupBy("icao", "lead_h").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in NUMERIC + TARGETS])


@register("leakage_audit", "select count(*) as n from frame_v where o0_time > t0 or t0 >= valid_time", FRAME)
def leakage_audit(v):
    return X.leakage(v.samples).agg(F.count(F.lit(1)).alias("n"))


REQUESTS = "select taf_id, icao, issued_at as t0, valid_hour as valid_time, cast(date_diff('hour', issued_at, valid_hour) as integer) as lead_h from hours_v"


@register("request_features", "select taf_id, icao, valid_time, lead_h, " + rounded("f_o0_vis", "f_dvis_3", "f_et_gust", "f_tend_t2m", "f_doy_cos") + " from asked_v",
          {"requests_v": REQUESTS, "asked_v": _features_sql("requests_v", "g.taf_id, g.icao, g.t0, g.valid_time, g.lead_h", False)})
def request_features(v):
    from fcverify.operators.expand import hour_grid
    asked = hour_grid(v.taf).select("icao", F.col("issued_at").alias("t0"), F.col("valid_hour").alias("valid_time"))
    out = X.request_features(asked, v.obs, v.nwp, v.stations)
    ids = v.taf.select("icao", F.col("issued_at").alias("t0"), "taf_id")
    return out.join(ids, ["icao", "t0"]).select("taf_id", "icao", "valid_time", "lead_h", *[
        F.col(c).cast("double").alias(c) for c in ("f_o0_vis", "f_dvis_3", "f_et_gust", "f_tend_t2m", "f_doy_cos")])


@register("hour_boundary_leads", "select obs_id, cast(date_diff('hour', observed_at, timestamp '2024-01-15 06:30:00') as integer) as lead_h from obs_v")
def hour_boundary_leads(v):
    return v.obs.select("obs_id", hour_boundaries(F.col("observed_at"), F.lit("2024-01-15 06:30:00").cast("timestamp")).alias("lead_h"))


@register("temporal_split", """select case when t0 < '2024-01-21' then 'train' when t0 < '2024-01-26' then 'val' else 'test' end as split,
 count(*) as n, min(t0) as first_t0, max(t0) as last_t0 from frame_v group by 1""", FRAME)
def temporal_split(v):
    split = P.split_name(F.col("t0"), FIXTURE_TRAIN_END, FIXTURE_VAL_END)
    return v.samples.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0"))


@register("grid_size", """select count(*) * 9 as grid_rows from obs_v where observed_at >= '2024-01-05' and observed_at < '2024-01-20'
 and (cast(floor(epoch(observed_at)/60) as bigint) % 1000003 * 7919) % 100 < 30""")
def grid_size(v):
    return X.grid_size(v.obs, LEADS_H, "2024-01-05", "2024-01-20", None, 30, P.minute_percent(F.col("observed_at")))


@register("sample_observations", "select obs_id from obs_v where (cast(floor(epoch(observed_at)/60) as bigint) % 1000003 * 7919) % 100 < 20")
def sample_observations(v):
    return P.keep_percent(v.obs, P.minute_percent(F.col("observed_at")), 20).select("obs_id")


@register("sample_issue_hours", "select taf_id from taf_v where abs(cast(floor(epoch(issued_at)/3600) as bigint)) % 100 < 25")
def sample_issue_hours(v):
    return P.keep_percent(v.taf, P.issue_hour_percent(F.col("issued_at")), 25).select("taf_id")


@register("sample_fixed_size", "select taf_id from taf_v order by (taf_id * 7919) % 10007, taf_id limit 50")
def sample_fixed_size(v):
    return P.fixed_size_sample(v.taf.select("taf_id"), 50, (F.col("taf_id") * 7919) % 10007, "taf_id")


@register("station_window_filter", "select obs_id from obs_v where icao in ('ST01','ST07') and observed_at >= '2024-01-10'")
def station_window_filter(v):
    return X.station_filter(X.time_window(v.obs, "observed_at", "2024-01-10"), ["ST01", "ST07"]).select("obs_id")


@register("station_semi_filter", "select obs_id from obs_v where icao in (select icao from station_v where region = 'ASIA')")
def station_semi_filter(v):
    return X.station_filter(v.obs, v.stations.filter("region = 'ASIA'")).select("obs_id")


@register("standard_leads", "select taf_id, valid_hour, lead_time_h from scored_v where lead_time_h in (1,2,3,6,9,12,18,24,30)")
def standard_leads(v):
    return v.scored.filter(F.col("lead_time_h").isin(*LEADS_H)).select("taf_id", "valid_hour", "lead_time_h")


@register("circular_encoding", "select obs_id, " + rounded("s", "c", "hs", "dc") + """, known from (select obs_id, coalesce(sin(radians(wind_dir_deg)),0) as s,
 coalesce(cos(radians(wind_dir_deg)),0) as c, sin(2*pi()*hour(observed_at)/24) as hs, cos(2*pi()*dayofyear(observed_at)/365) as dc,
 case when wind_dir_deg is null then 0 else 1 end as known from obs_v) x""")
def circular_encoding(v):
    s, c, known = sin_cos_known("w", F.col("wind_dir_deg"))
    hs, _, _, dc = day_cycle("", F.col("observed_at"))
    return v.obs.select("obs_id", s.alias("s"), c.alias("c"), hs.alias("hs"), dc.alias("dc"), known.alias("known"))


# --- sequences --------------------------------------------------------------

AXIS = """select icao, lo, hi, unnest(generate_series(lo, hi, interval 1 hour)) as hour from (select icao,
 date_trunc('hour', min(observed_at)) as lo, date_trunc('hour', max(observed_at)) as hi from obs_v group by 1)"""
_CODE = "case {0} when 'LIFR' then 0 when 'IFR' then 1 when 'MVFR' then 2 when 'VFR' then 3 end"
ENCODER = f"""select a.icao, a.hour, o.vis_m as vis, cast(coalesce(o.ceiling_ft, 30000) as double) as ceiling,
 case when o.ceiling_ft is null then 0.0 else 1.0 end as has_ceiling, o.wind_spd_kt as wspd, coalesce(sin(radians(o.wind_dir_deg)),0) as wdir_sin,
 coalesce(cos(radians(o.wind_dir_deg)),0) as wdir_cos, o.temp_c - o.dewpoint_c as spread, o.temp_c as temp,
 cast({_CODE.format('o.flight_category')} as double) as cat_code,
 case when date_diff('microsecond', o.observed_at, a.hour) <= 21600000000 then 1.0 else 0.0 end as fresh
 from axis_v a asof left join obs_v o on o.icao = a.icao and o.observed_at <= a.hour"""
NEAR30 = """select * from (select a.icao, a.hour, o.vis_m, o.ceiling_ft, o.wind_spd_kt, o.flight_category, o.obs_id, row_number() over (partition by a.icao, a.hour
 order by abs(date_diff('microsecond', a.hour, o.observed_at)), o.observed_at desc, o.obs_id desc) as rn from axis_v a join obs_v o on o.icao = a.icao
 and o.observed_at between a.hour - interval 30 minute and a.hour + interval 30 minute) where rn = 1"""
TARGET = f"""select a.icao, a.hour, coalesce(n.vis_m, 0) as vis, cast(coalesce(n.ceiling_ft, 30000) as double) as ceiling, coalesce(n.wind_spd_kt,0) as wspd,
 case when n.flight_category is null then 0 else 1 end as has_obs, coalesce({_CODE.format('n.flight_category')}, -1) as cat
 from axis_v a left join near_v n on n.icao = a.icao and n.hour = a.hour"""
SEQ = {"axis_v": AXIS, "encoder_v": ENCODER, "near_v": NEAR30, "target_v": TARGET, "state_v": """select e.icao, e.hour, a.lo, a.hi, e.fresh,
 coalesce(e.vis,0) as vis, coalesce(e.cat_code,0) as cat_code, coalesce(w.t2m_c,0) as t2m, coalesce(w.gust,0) as gust,
 t.vis as t_vis, t.has_obs, t.cat, cast(epoch(e.hour)/3600 as bigint) as i
 from encoder_v e join axis_v a on a.icao = e.icao and a.hour = e.hour join target_v t on t.icao = e.icao and t.hour = e.hour
 left join nwp_v w on w.icao = e.icao and w.valid_time = e.hour and w.source = 'era5'""",
       "issue_v": """select * from state_v where fresh = 1 and date_diff('hour', lo, hour) >= 11 and date_diff('hour', hour, hi) >= 30
 and date_diff('hour', lo, hi) + 1 >= 43"""}


@register("hourly_axis", "select icao, count(*) as n, min(hour) as first_hour, max(hour) as last_hour from axis_v group by 1", SEQ)
def hourly_axis(v):
    return Q.hourly_axis(v.obs).groupBy("icao").agg(
        F.count(F.lit(1)).alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


@register("encoder_state", "select icao, hour, " + rounded("vis", "ceiling", "has_ceiling", "wspd", "wdir_sin", "wdir_cos", "spread", "temp", "cat_code", "fresh")
          + " from encoder_v", SEQ)
def encoder_state(v):
    return Q.encoder_state(Q.hourly_axis(v.obs), v.obs)


@register("target_mask", "select icao, hour, has_obs, cat, round(ceiling,6) as ceiling, round(vis,6) as vis from target_v", SEQ)
def target_mask(v):
    return Q.target_state(Q.hourly_axis(v.obs), v.obs).select(
        "icao", "hour", "has_obs", F.coalesce("cat_code", F.lit(-1)).alias("cat"), "ceiling", F.coalesce("vis", F.lit(0.0)).alias("vis"))


@register("covariate_hours", """select a.icao, a.hour, round(w.gust,6) as et_gust, round(w.t2m_c - w.d2m_c,6) as et_spread,
 round(coalesce(sin(radians(w.wind10m_dir)),0),6) as et_wdir_sin from axis_v a left join nwp_v w on w.icao = a.icao and w.valid_time = a.hour and w.source='era5'""", SEQ)
def covariate_hours(v):
    return Q.covariates(Q.hourly_axis(v.obs), v.nwp).select("icao", "hour", "et_gust", "et_spread", "et_wdir_sin")


_WINDOWS = """select t.icao, t.hour as t0, p.n as n_past, round(p.vis,6) as past_vis, round(p.cat,6) as past_cat, f.n as n_future, round(f.t2m,6) as future_t2m,
 round(f.gust,6) as future_gust, round(f.vis,6) as target_vis, cast(f.mask as bigint) as mask, cast(f.cat as bigint) as cat from issue_v t
 join (select t.icao, t.i, count(*) as n, sum((s.i-t.i+12)*s.vis) as vis, sum((s.i-t.i+12)*s.cat_code) as cat from issue_v t join state_v s
  on s.icao = t.icao and s.i between t.i-11 and t.i group by 1, 2) p on p.icao = t.icao and p.i = t.i
 join (select t.icao, t.i, count(*) as n, sum((s.i-t.i)*s.t2m) as t2m, sum((s.i-t.i)*s.gust) as gust, sum((s.i-t.i)*s.t_vis) as vis,
  sum((s.i-t.i)*s.has_obs) as mask, sum((s.i-t.i)*s.cat) as cat from issue_v t join state_v s on s.icao = t.icao and s.i between t.i+1 and t.i+30 group by 1, 2) f
 on f.icao = t.icao and f.i = t.i"""


@register("sequence_windows", _WINDOWS, SEQ)
def sequence_windows(v):
    """Order-weighted sums over every window, so that a shifted step would show."""
    rows = Q.sequence_windows(v.obs, v.nwp, v.stations)

    def weighted(column, value):
        terms = F.transform(column, lambda x, k: (k + 1) * value(x).cast("double"))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    fut = {n: i for i, n in enumerate(Q.COVARIATES)}
    return rows.select(
        "icao", "t0", F.size("x_past").cast("long").alias("n_past"), weighted("x_past", lambda x: x[0]).alias("past_vis"),
        weighted("x_past", lambda x: x[8]).alias("past_cat"), F.size("x_future").cast("long").alias("n_future"),
        weighted("x_future", lambda x: x[fut["et_t2m"]]).alias("future_t2m"),
        weighted("x_future", lambda x: x[fut["et_gust"]]).alias("future_gust"),
        weighted("y_reg", lambda x: x[0]).alias("target_vis"),
        weighted("y_mask", lambda x: x).cast("long").alias("mask"), weighted("y_cat", lambda x: x).cast("long").alias("cat"))


@register("sequence_leads", "select icao, count(*) as n, 465 * count(*) as lead_sum from issue_v group by 1", SEQ)
def sequence_leads(v):
    rows = Q.sequence_windows(v.obs, v.nwp, v.stations)
    leads = F.aggregate(F.transform("x_future", lambda x: x[10].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("icao").agg(F.count(F.lit(1)).alias("n"), F.sum(leads).alias("lead_sum"))


@register("sequence_stations", "select icao, row_number() over (order by icao) - 1 as station_id from (select distinct icao from issue_v)", SEQ)
def sequence_stations(v):
    return Q.station_ids(v.obs, v.nwp, v.stations)


@register("sequence_split", """select case when hour < '2024-01-21' then 'train' when hour < '2024-01-26' then 'val' else 'test' end as split, count(*) as n
 from issue_v where abs(i) % 100 < 40 group by 1""", SEQ)
def sequence_split(v):
    rows = Q.build_sequences(v.obs, v.nwp, v.stations, sample_pct=40)
    return Q.split_sequences(rows, FIXTURE_TRAIN_END, FIXTURE_VAL_END).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
