"""Queries: the read-side views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fcverify.catalog import register, rounded
from fcverify.catalog.verify import RATIOS, SKILL
from fcverify.functions.conditions import category_rank
from fcverify.plans import serving
from fcverify.operators.rollups import table_counts

WINDOW = ("2024-01-10", "2024-01-17")


@register("stations_latest", """select s.icao, s.name, round(s.lat,6) as lat, round(s.lon,6) as lon, s.elevation_m, s.region, o.observed_at, o.flight_category
 from station_v s left join (select * from (select *, row_number() over (partition by icao order by observed_at desc, obs_id desc) as rn from obs_v) where rn=1) o
 on o.icao = s.icao""")
def stations_latest(v):
    return serving.stations_latest(v.stations, v.obs)


@register("served_order", """select 'stations' as view, icao, cast(null as timestamp) as at, row_number() over (order by region, icao) as place from station_v
 union all select 'observations', icao, observed_at, row_number() over (order by observed_at) from obs_v where icao = 'ST07' and observed_at >= '2024-01-10'
 and observed_at < '2024-01-17' qualify row_number() over (partition by observed_at order by obs_id) = 1""")
def served_order(v):
    """The order in which two views give their rows, as places. Times of one station that repeat count once."""
    def placed(rows, name, time):
        # the order of a sorted result is that of its partitions and of the rows in them
        rows = rows.select("icao", time.alias("at"), F.monotonically_increasing_id().alias("_o")).groupBy("icao", "at").agg(F.min("_o").alias("_o"))
        return rows.select(F.lit(name).alias("view"), "icao", "at", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("_o")).alias("place"))

    series = serving.observation_series(v.obs, "st07", *WINDOW)
    return placed(serving.stations_latest(v.stations, v.obs), "stations", F.lit(None).cast("timestamp")).unionByName(
        placed(series, "observations", F.col("observed_at")))


@register("one_station", "select icao, name, round(lat,6) as lat, round(lon,6) as lon, elevation_m, region from station_v where icao = 'ST07'")
def one_station(v):
    return serving.station(v.stations, "st07")


@register("observation_series", "select icao, observed_at, flight_category, round(vis_m,6) as vis_m from obs_v where observed_at >= '2024-01-10' and observed_at < '2024-01-17'")
def observation_series(v):
    return serving.observation_series(v.obs, None, *WINDOW).select("icao", "observed_at", "flight_category", "vis_m")


@register("nested_groups", """select t.taf_id, t.icao, t.issued_at, count(*) as n_groups,
 string_agg(group_type, '>' order by g.valid_from, group_seq) as types from taf_v t join group_v g on g.taf_id = t.taf_id
 where t.issued_at >= '2024-01-10' and t.issued_at < '2024-01-17' group by 1, 2, 3""")
def nested_groups(v):
    rows = serving.forecasts_with_groups(v.taf, v.groups, None, *WINDOW)
    return rows.select("taf_id", "icao", "issued_at", F.size("groups").cast("long").alias("n_groups"),
                       F.array_join(F.transform("groups", lambda g: g["group_type"]), ">").alias("types"))


@register("nwp_series", "select icao, valid_time, source, round(gust,6) as gust, round(cbh_m,6) as cbh_m from nwp_v where valid_time >= '2024-01-10' and valid_time < '2024-01-17'")
def nwp_series(v):
    return serving.nwp_series(v.nwp, None, *WINDOW).select("icao", "valid_time", "source", "gust", "cbh_m")


@register("scorecard_skill", f"select icao, n, hits, misses, false_alarms, correct_neg, {RATIOS} from (select icao, {SKILL} from verif_v where scoring_profile='categorical' group by 1)")
def scorecard_skill(v):
    return serving.scorecard(v.verification)["skill"]


@register("verification_rows", "select icao, valid_hour, lead_time_h, fcst_category, obs_category, category_outcome, "
          + rounded("wind_err_kt", "vis_err_m", "ceiling_err_ft", "weighted_score") + " from verif_v")
def verification_rows(v):
    return serving.verification_rows(v.verification)


@register("prevailing_steps", """select g.taf_id, t.icao, g.valid_from, case flight_category when 'LIFR' then 0 when 'IFR' then 1 when 'MVFR' then 2 else 3 end as category_rank
 from group_v g join taf_v t on t.taf_id = g.taf_id where group_type in ('BASE','FM') and flight_category is not null""")
def prevailing_steps(v):
    return serving.prevailing_step_series(v.taf, v.groups)


@register("status_counts", """select 'stations' as table_name, count(*) as n from station_v union all select 'metar_obs', count(*) from obs_v
 union all select 'taf_forecast', count(*) from taf_v union all select 'taf_group', count(*) from group_v
 union all select 'nwp_point', count(*) from nwp_v union all select 'verification_hourly', count(*) from verif_v""")
def status_counts(v):
    return table_counts({"stations": v.stations, "metar_obs": v.obs, "taf_forecast": v.taf, "taf_group": v.groups,
                         "nwp_point": v.nwp, "verification_hourly": v.verification})


@register("category_ranks", "select obs_id, case flight_category when 'LIFR' then 0 when 'IFR' then 1 when 'MVFR' then 2 when 'VFR' then 3 end as r from obs_v")
def category_ranks(v):
    return v.obs.select("obs_id", category_rank(F.col("flight_category")).alias("r"))
