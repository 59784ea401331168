"""Views that give the star-schema test tables the shape of weather tables.

``Views`` builds them as DataFrames, ``CTES`` states the same views as SQL for the
oracle. Both are derived from ``events``, ``nation`` and ``region``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fcverify.functions.conditions import flight_category
from fcverify.functions.timetokens import hour_floor
from fcverify.operators import forecasters
from fcverify.operators.expand import expand
from fcverify.operators.features import training_samples
from fcverify.operators.nearest import align_hours
from fcverify.operators.verification import OBSERVED, score_hours, score_profiles
from fcverify.session import prepare

# Split dates inside the 30 days the events cover.
FIXTURE_TRAIN_END = "2024-01-21"
FIXTURE_VAL_END = "2024-01-26"
# Session setting: partitions to deal the event table to. Unset, the splits of its files are used.
DEAL_EVENTS = "spark.fcverify.fixture.partitions"


class Views:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """The event table, dealt to as many partitions as the session asks for, if it does.

        Decoding and expansion are compute-bound, and a file of one row group is one split.
        """
        rows, dealt = self.table("events"), self.spark.conf.get(DEAL_EVENTS, None)
        return ((rows.repartition(int(dealt)) if dealt else rows)
                .withColumn("ts", F.col("ts").cast("timestamp"))
                .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
                .withColumn("icao", F.concat(F.lit("ST"), F.lpad((F.col("user_id") % 25).cast("string"),
                                                                 2, "0"))))

    @cached_property
    def obs(self) -> DataFrame:
        k = F.col("k")
        rows = self.events.select(
            F.col("event_id").alias("obs_id"), "icao", F.col("ts").alias("observed_at"),
            F.least(F.lit(10000.0), F.round(F.col("value") * 400)).alias("vis_m"),
            F.when(~F.col("event_type").isin("view", "signup"), (k * 80).cast("int")).alias("ceiling_ft"),
            F.when(k % 17 != 0, ((k * 37) % 360).cast("int")).alias("wind_dir_deg"),
            (k % 35).cast("double").alias("wind_spd_kt"),
            F.when(k % 5 == 0, (k % 35 + 10).cast("double")).alias("wind_gust_kt"),
            (k % 30 - 5).cast("double").alias("temp_c"),
            (k % 30 - 5 - k % 6).cast("double").alias("dewpoint_c"),
            (990 + k % 45).cast("double").alias("qnh_hpa"))
        return rows.withColumn("flight_category", flight_category(F.col("ceiling_ft"), F.col("vis_m")))

    @cached_property
    def taf(self) -> DataFrame:
        hour = hour_floor(F.col("ts"))
        return self.events.filter(F.col("event_type") == "signup").select(
            F.col("event_id").alias("taf_id"), "icao", F.col("ts").alias("issued_at"),
            (hour + F.expr("interval 1 hour")).alias("valid_from"),
            (hour + F.expr("interval 25 hour")).alias("valid_to"), "value")

    @cached_property
    def groups(self) -> DataFrame:
        g, taf = F.col("g"), F.col("taf_id")
        after = lambda h: F.col("valid_from") + F.expr(f"interval {h} hour")
        rows = self.taf.withColumn("g", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
            "taf_id", g.alias("group_seq"),
            F.when(g == 0, "BASE").when((g == 1) & (taf % 2 == 0), "FM").when(g == 1, "BECMG")
            .when(g == 2, "TEMPO").when(taf % 3 == 0, "PROB30").when(taf % 3 == 1, "PROB40")
            .otherwise("PROB30_TEMPO").alias("group_type"),
            F.when(g == 3, F.when(taf % 3 == 1, 40).otherwise(30)).alias("probability"),
            F.when(g == 0, F.col("valid_from")).when(g == 1, after(4)).when(g == 2, after(8))
            .otherwise(after(14)).alias("_from"),
            F.when(g == 0, F.col("valid_to"))
            .when(g == 1, F.when(taf % 2 == 0, F.col("valid_to")).otherwise(after(6)))
            .when(g == 2, after(12)).otherwise(after(18)).alias("_to"),
            F.when((taf + g) % 7 != 6, ((taf * 13 + g * 50) % 360).cast("int")).alias("wind_dir_deg"),
            ((taf + g * 5) % 30).cast("double").alias("wind_spd_kt"),
            F.lit(None).cast("double").alias("wind_gust_kt"),
            F.when(~((g == 1) & (taf % 4 == 1)),
                   F.least(F.lit(10000.0), F.round(F.col("value") * 400 / (g + 1)))).alias("vis_m"),
            F.when((taf + g) % 3 != 0, (((taf + g * 7) % 50) * 100).cast("int")).alias("ceiling_ft"))
        return (rows.withColumnsRenamed({"_from": "valid_from", "_to": "valid_to"})
                .withColumn("flight_category", flight_category(F.col("ceiling_ft"), F.col("vis_m"))))

    @cached_property
    def stations(self) -> DataFrame:
        key = F.col("n_nationkey")
        regions = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self.table("nation").join(regions, "n_regionkey").select(
            F.concat(F.lit("ST"), F.lpad(key.cast("string"), 2, "0")).alias("icao"),
            F.col("n_name").alias("name"), (key * 0.45 + 29.3).cast("double").alias("lat"),
            (key * 0.87 - 11).cast("double").alias("lon"),
            ((key * 37) % 700).cast("int").alias("elevation_m"), F.col("r_name").alias("region"))

    @cached_property
    def nwp(self) -> DataFrame:
        k = F.col("k")
        per_hour = (self.events.groupBy("icao", hour_floor(F.col("ts")).alias("valid_time"))
                    .agg(F.max("k").alias("k")))
        as_double = lambda c, name: c.cast("double").alias(name)
        return per_hour.select(
            "icao", "valid_time", F.when(k % 10 == 9, "other").otherwise("era5").alias("source"),
            as_double((k % 40) * 0.5, "wind10m_spd"), as_double((k * 17) % 360, "wind10m_dir"),
            as_double(k % 50, "gust"), as_double(k % 30, "t2m_c"), as_double(k % 30 - k % 7, "d2m_c"),
            as_double((k % 9) / 8.0, "tcc"), as_double((k % 3) / 4.0, "lcc"),
            as_double((k % 5) / 8.0, "mcc"), as_double((k % 7) / 8.0, "hcc"),
            F.when(k % 3 != 0, as_double(k * 30, "cbh_m")).alias("cbh_m"),
            as_double((k % 4) * 0.25, "tp_mm"), as_double(k % 30 + 1000, "mslp_hpa"))

    @cached_property
    def grid(self) -> DataFrame:
        cells = self.events.groupBy(
            hour_floor(F.col("ts")).alias("time"),
            (F.col("user_id") % 5 * 2.5 + 30).cast("double").alias("latitude"),
            (F.col("event_id") % 5 * 5 - 10).cast("double").alias("longitude"),
        ).agg(F.max("k").alias("a"), F.min("k").alias("b"))
        a, b = F.col("a"), F.col("b")
        d = lambda c, name: c.cast("double").alias(name)
        return cells.select(
            "time", "latitude", "longitude", d(a % 21 - 10, "u10"), d(b % 17 - 8, "v10"),
            d(a % 25, "fg10"), d(a % 30 + 270, "t2m"),
            F.when(b % 6 == 0, F.lit(float("nan"))).otherwise((b % 20 + 265).cast("double")).alias("d2m"),
            d((a % 9) / 8.0, "tcc"), d(b * 25, "cbh"), d((a % 5) / 1024.0, "tp"), d(a % 40 * 100 + 99000, "msl"))

    @cached_property
    def expected(self) -> DataFrame:
        return expand(self.taf, self.groups)

    @cached_property
    def aligned(self) -> DataFrame:
        return align_hours(self.expected, self.obs, OBSERVED)

    @cached_property
    def scored(self) -> DataFrame:
        """Verification rows of the official forecasts."""
        return score_hours(self.aligned)

    @cached_property
    def verification(self) -> DataFrame:
        """Verification rows of all bulk profiles."""
        return score_profiles(self.taf, self.obs, self.groups, tuple(forecasters.BULK_PROFILES))

    @cached_property
    def model_points(self) -> DataFrame:
        """Scored hours with three formula probabilities in place of model output."""
        a = F.col("taf_id") * 7 + F.col("lead_time_h") * 13
        b = F.col("taf_id") * 11 + F.col("lead_time_h") * 5
        event = F.when(F.col("obs_category").isin("IFR", "LIFR"), 1).otherwise(0)
        shrink = lambda x: ((x % 97) / 96.0 * 0.6 + event * 0.3).cast("double")
        return self.scored.select(
            "taf_id", "icao", "valid_hour", F.col("lead_time_h").alias("lead_h"), event.alias("event"),
            shrink(a).alias("p"), shrink(b).alias("p2"), F.col("fcst_prob").alias("p_official"))

    @cached_property
    def samples(self) -> DataFrame:
        return training_samples(self.obs, self.nwp, self.stations)


def _category(ceiling: str, vis: str) -> str:
    return (f"case when {ceiling} is null and {vis} is null then null "
            f"when {ceiling} < 500 or {vis} < 1600 then 'LIFR' "
            f"when {ceiling} < 1000 or {vis} < 4800 then 'IFR' "
            f"when {ceiling} < 3000 or {vis} < 8000 then 'MVFR' else 'VFR' end")


def _rank(c: str) -> str:
    return f"case {c} when 'LIFR' then 0 when 'IFR' then 1 when 'MVFR' then 2 when 'VFR' then 3 end"


_ADVERSE = "in ('IFR','LIFR')"

_SCORE = f"""
 select x.taf_id, x.icao, x.valid_hour,
  cast(floor(date_diff('microsecond', issued_at, x.valid_hour) / 3600000000.0) as integer) as lead_time_h,
  scoring_profile, p_cat as fcst_category, o.flight_category as obs_category,
  case when o.flight_category {_ADVERSE} and w then 'hit' when o.flight_category {_ADVERSE} then 'miss'
   when w then 'false_alarm' else 'correct_neg' end as category_outcome,
  coalesce(p_given, case when p_cat {_ADVERSE} then 1.0 else greatest(
    case when t_cat {_ADVERSE} then 0.4 else 0.0 end,
    case when q_cat {_ADVERSE} then coalesce(q_prob / 100.0, 0.4) else 0.0 end) end) as fcst_prob,
  p_spd - o.wind_spd_kt as wind_err_kt,
  180 - abs(abs(p_dir - o.wind_dir_deg) - 180) as dir_err_deg,
  cast(null as double) as temp_err_c, p_vis - o.vis_m as vis_err_m, p_ceil - o.ceiling_ft as ceiling_err_ft,
  case when o.flight_category is null then 0.0 when p_cat = o.flight_category then 3.0 else greatest(
    case when abs(({_rank('p_cat')}) - ({_rank('o.flight_category')})) = 1 then 1.0 else 0.0 end,
    case when t_cat = o.flight_category then 2.0 else 0.0 end,
    case when q_cat = o.flight_category then case when coalesce(q_prob,0) < 40 then 1.0 else 1.5 end else 0.0 end
  ) end as weighted_score
 from (select *, coalesce(p_cat {_ADVERSE}, false) or coalesce(t_cat {_ADVERSE}, false)
         or coalesce(q_cat {_ADVERSE}, false) as w from allhours_v) x
 join best_v o on o.icao = x.icao and o.valid_hour = x.valid_hour
"""

# Oracle views. A query names the ones it needs; dependencies are added.
CTES: dict[str, str] = {
    "ev_v": """select *, cast(json_extract_string(props,'$.k') as integer) as k,
  concat('ST', lpad(cast(user_id % 25 as varchar), 2, '0')) as icao from events""",
    "obs_v": f"""select *, {_category('ceiling_ft', 'vis_m')} as flight_category from (
 select event_id as obs_id, icao, ts as observed_at, least(10000.0, round(value*400)) as vis_m,
  case when event_type in ('view','signup') then null else k*80 end as ceiling_ft,
  case when k%17=0 then null else (k*37)%360 end as wind_dir_deg, cast(k%35 as double) as wind_spd_kt,
  case when k%5=0 then cast(k%35+10 as double) end as wind_gust_kt, cast(k%30-5 as double) as temp_c,
  cast(k%30-5-k%6 as double) as dewpoint_c, cast(990+k%45 as double) as qnh_hpa from ev_v) o""",
    "taf_v": """select event_id as taf_id, icao, ts as issued_at, date_trunc('hour',ts) + interval 1 hour as valid_from,
  date_trunc('hour',ts) + interval 25 hour as valid_to, value from ev_v where event_type='signup'""",
    "group_v": f"""select *, {_category('ceiling_ft', 'vis_m')} as flight_category from (
 select taf_id, g as group_seq,
  case g when 0 then 'BASE' when 1 then case when taf_id%2=0 then 'FM' else 'BECMG' end when 2 then 'TEMPO'
   else case taf_id%3 when 0 then 'PROB30' when 1 then 'PROB40' else 'PROB30_TEMPO' end end as group_type,
  case when g=3 then case when taf_id%3=1 then 40 else 30 end end as probability,
  case g when 0 then valid_from when 1 then valid_from + interval 4 hour when 2 then valid_from + interval 8 hour
   else valid_from + interval 14 hour end as valid_from,
  case g when 0 then valid_to when 1 then case when taf_id%2=0 then valid_to else valid_from + interval 6 hour end
   when 2 then valid_from + interval 12 hour else valid_from + interval 18 hour end as valid_to,
  case when (taf_id+g)%7=6 then null else cast((taf_id*13+g*50)%360 as integer) end as wind_dir_deg,
  cast((taf_id+g*5)%30 as double) as wind_spd_kt, cast(null as double) as wind_gust_kt,
  case when g=1 and taf_id%4=1 then null else least(10000.0, round(value*400/(1+g))) end as vis_m,
  case when (taf_id+g)%3=0 then null else cast(((taf_id+7*g)%50)*100 as integer) end as ceiling_ft
 from taf_v, (select unnest([0,1,2,3]) as g) gg) q""",
    "station_v": """select concat('ST', lpad(cast(n_nationkey as varchar),2,'0')) as icao, n_name as name,
  cast(n_nationkey*0.45 + 29.3 as double) as lat, cast(n_nationkey*0.87 - 11 as double) as lon,
  cast((n_nationkey*37)%700 as integer) as elevation_m, r_name as region
 from nation join region on n_regionkey = r_regionkey""",
    "nwp_v": """select icao, valid_time, case when k%10=9 then 'other' else 'era5' end as source,
  (k%40)*0.5::double as wind10m_spd, cast((k*17)%360 as double) as wind10m_dir, cast(k%50 as double) as gust,
  cast(k%30 as double) as t2m_c, cast(k%30-k%7 as double) as d2m_c, (k%9)/8.0::double as tcc,
  (k%3)/4.0::double as lcc, (k%5)/8.0::double as mcc, (k%7)/8.0::double as hcc,
  case when k%3=0 then null else cast(k*30 as double) end as cbh_m, (k%4)*0.25::double as tp_mm,
  cast(1000+k%30 as double) as mslp_hpa
 from (select icao, date_trunc('hour',ts) as valid_time, max(k) as k from ev_v group by all)""",
    "grid_v": """select time, latitude, longitude, cast(a%21-10 as double) as u10, cast(b%17-8 as double) as v10,
  cast(a%25 as double) as fg10, cast(270+a%30 as double) as t2m,
  case when b%6=0 then cast('nan' as double) else cast(265+b%20 as double) end as d2m,
  (a%9)/8.0::double as tcc, cast(b*25 as double) as cbh, (a%5)/1024.0::double as tp,
  cast(99000+(a%40)*100 as double) as msl
 from (select date_trunc('hour',ts) as time, cast(30+(user_id%5)*2.5 as double) as latitude,
  cast((event_id%5)*5-10 as double) as longitude, max(k) as a, min(k) as b from ev_v group by all)""",
    "hours_v": """select taf_id, icao, issued_at, valid_from, valid_to, unnest(generate_series(
  date_trunc('hour', valid_from), valid_to - interval 1 microsecond, interval 1 hour)) as valid_hour from taf_v""",
    "change_v": """select h.taf_id, h.valid_hour, g.*exclude(taf_id), row_number() over (
   partition by h.taf_id, h.valid_hour order by case when group_type='FM' then g.valid_from else g.valid_to end, group_seq) as ord
 from hours_v h join group_v g on g.taf_id = h.taf_id
 where group_type in ('FM','BECMG') and case when group_type='FM' then g.valid_from else g.valid_to end <= h.valid_hour""",
    "reset_v": """select *, max(case when group_type='FM' then ord end) over (partition by taf_id, valid_hour) as fm
 from change_v""",
    "merged_v": """select taf_id, valid_hour, max(fm) as fm,
  arg_max(wind_dir_deg, ord) filter (where wind_dir_deg is not null and ord >= coalesce(fm,0)) as wind_dir_deg,
  arg_max(wind_spd_kt, ord) filter (where wind_spd_kt is not null and ord >= coalesce(fm,0)) as wind_spd_kt,
  arg_max(vis_m, ord) filter (where vis_m is not null and ord >= coalesce(fm,0)) as vis_m,
  arg_max(ceiling_ft, ord) filter (where ceiling_ft is not null and ord >= coalesce(fm,0)) as ceiling_ft
 from reset_v group by all""",
    "overlay_v": """select h.taf_id, h.valid_hour,
  arg_max(flight_category, group_seq) filter (where group_type like 'TEMPO%') as t_cat,
  arg_max(struct_pack(c := flight_category, p := probability), group_seq) filter (where group_type like 'PROB%') as q,
  arg_max(vis_m, group_seq) filter (where group_type like 'TEMPO%') as t_vis
 from hours_v h join group_v g on g.taf_id = h.taf_id and g.valid_from <= h.valid_hour and h.valid_hour < g.valid_to
 where group_type like 'TEMPO%' or group_type like 'PROB%' group by all""",
    "prevailing_v": """select h.*,
  case when m.fm is not null then m.wind_dir_deg else coalesce(m.wind_dir_deg, b.wind_dir_deg) end as p_dir,
  case when m.fm is not null then m.wind_spd_kt else coalesce(m.wind_spd_kt, b.wind_spd_kt) end as p_spd,
  case when m.fm is not null then m.vis_m else coalesce(m.vis_m, b.vis_m) end as p_vis,
  case when m.fm is not null then m.ceiling_ft else coalesce(m.ceiling_ft, b.ceiling_ft) end as p_ceil
 from hours_v h left join group_v b on b.taf_id = h.taf_id and b.group_type='BASE'
 left join merged_v m on m.taf_id = h.taf_id and m.valid_hour = h.valid_hour""",
    "expected_v": f"""select p.taf_id, icao, issued_at, valid_from, valid_to, p.valid_hour,
  cast(p_dir as double) as p_dir, p_spd, p_vis,
  cast(p_ceil as double) as p_ceil, {_category('p_ceil', 'p_vis')} as p_cat, t_cat, q.c as q_cat, q.p as q_prob,
  cast(null as double) as p_given, 'categorical' as scoring_profile
 from prevailing_v p left join overlay_v o on o.taf_id = p.taf_id and o.valid_hour = p.valid_hour""",
    "best_v": """select * from (select h.valid_hour, o.*, row_number() over (partition by h.icao, h.valid_hour order by
   abs(date_diff('microsecond', h.valid_hour, o.observed_at)), o.observed_at desc, o.obs_id desc) as rn
 from (select distinct icao, valid_hour from hours_v) h join obs_v o on o.icao = h.icao
  and o.observed_at between h.valid_hour - interval 40 minute and h.valid_hour + interval 40 minute) where rn = 1""",
    "anchor_v": """select * from (select t.taf_id, o.*exclude(icao), row_number() over (partition by t.taf_id order by
   case when abs(date_diff('microsecond', t.issued_at, o.observed_at)) <= 2400000000 then 0 else 1 end,
   abs(date_diff('microsecond', t.issued_at, o.observed_at)), o.observed_at desc, o.obs_id desc) as rn
 from taf_v t join obs_v o on o.icao = t.icao and o.observed_at <= t.issued_at + interval 40 minute) where rn = 1""",
    "persist_v": """select h.taf_id, icao, issued_at, valid_from, valid_to, valid_hour, cast(wind_dir_deg as double) as p_dir,
  wind_spd_kt as p_spd, vis_m as p_vis, cast(ceiling_ft as double) as p_ceil, flight_category as p_cat,
  cast(null as varchar) as t_cat, cast(null as varchar) as q_cat, cast(null as integer) as q_prob,
  cast(null as double) as p_given, 'persistence' as scoring_profile
 from hours_v h join anchor_v a on a.taf_id = h.taf_id""",
    "modal_v": f"""select icao, hod, r from (select icao, hour(observed_at) as hod, {_rank('flight_category')} as r,
   row_number() over (partition by icao, hour(observed_at) order by count(*) desc, {_rank('flight_category')}) as rn
  from obs_v where flight_category is not null group by icao, hour(observed_at), flight_category) where rn = 1""",
    "clim_v": f"""select c.icao, c.hod, vis_m, ceiling_ft, p_adverse,
  coalesce(list_extract(['LIFR','IFR','MVFR','VFR'], r + 1), {_category('ceiling_ft', 'vis_m')}) as flight_category
 from (select icao, hour(observed_at) as hod, median(vis_m) as vis_m, median(ceiling_ft) as ceiling_ft,
   coalesce(avg(case when flight_category is null then null when flight_category {_ADVERSE} then 1.0 else 0.0 end), 0.0) as p_adverse
  from obs_v group by all) c left join modal_v m on m.icao = c.icao and m.hod = c.hod""",
    "climhours_v": """select h.taf_id, h.icao, issued_at, valid_from, valid_to, valid_hour, cast(null as double) as p_dir,
  cast(null as double) as p_spd, vis_m as p_vis, cast(ceiling_ft as double) as p_ceil, flight_category as p_cat,
  cast(null as varchar) as t_cat, cast(null as varchar) as q_cat, cast(null as integer) as q_prob,
  coalesce(p_adverse, 0.0) as p_given, 'climatology' as scoring_profile
 from hours_v h left join clim_v c on c.icao = h.icao and c.hod = hour(h.valid_hour)""",
    "scored_v": _SCORE.replace("allhours_v", "expected_v"),
    "verif_v": " union all ".join(_SCORE.replace("allhours_v", v) for v in
                                  ("expected_v", "persist_v", "climhours_v")),
    "point_v": f"""select taf_id, icao, valid_hour, lead_time_h as lead_h,
  case when obs_category {_ADVERSE} then 1 else 0 end as event,
  cast(((taf_id*7+lead_time_h*13) % 97)/96.0::double * 0.6 + (case when obs_category {_ADVERSE} then 1 else 0 end) * 0.3::double as double) as p,
  cast(((taf_id*11+lead_time_h*5) % 97)/96.0::double * 0.6 + (case when obs_category {_ADVERSE} then 1 else 0 end) * 0.3::double as double) as p2,
  fcst_prob as p_official from scored_v""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH clause holding the views it mentions."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z0-9]+_v\b", text)):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" + body


def own_window_score(name: str, obs: str, lower: str, hours: str) -> dict[str, str]:
    """Oracle views that score ``hours`` against each forecast's own observations."""
    near = f"{name}near_v"
    pick = f"""select * from (select h.taf_id, h.valid_hour, o.*, row_number() over (partition by h.taf_id, h.valid_hour order by
   abs(date_diff('microsecond', h.valid_hour, o.observed_at)), o.observed_at desc, o.obs_id desc) as rn
 from {hours} h join {obs} o on o.icao = h.icao and o.observed_at between h.valid_hour - interval 40 minute and h.valid_hour + interval 40 minute
  and o.observed_at >= {lower} and o.observed_at < h.valid_to) where rn = 1"""
    score = _SCORE.replace("allhours_v", hours).replace(
        "best_v o on o.icao = x.icao and o.valid_hour", f"{near} o on o.taf_id = x.taf_id and o.valid_hour")
    return {near: pick, f"{name}_v": score}
