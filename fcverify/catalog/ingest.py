"""Queries: feeds, message decoding, stored tables, gridded model input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fcverify.catalog import register
from fcverify.functions import conditions as C
from fcverify.functions.timetokens import resolve_time
from fcverify.operators import decode as D
from fcverify.operators import grid as G
from fcverify.plans.backfill import Store, rescore
from fcverify.session import checkpoint_folder
from fcverify.sources import feeds
from fcverify.sources import tables as T
from fcverify.sources.dated import DatedTable, day_of, pending

# --- messages built from the test tables, to be decoded back ----------------

_two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
_three = lambda c: F.lpad(c.cast("int").cast("string"), 3, "0")
_stamp = lambda t: F.date_format(t, "ddHHmm")
_hour = lambda t: F.date_format(t, "ddHH")


def _wind(d, s, g):
    return F.concat(F.coalesce(_three(d), F.lit("VRB")), _two(s), F.coalesce(F.concat(F.lit("G"), _two(g)), F.lit("")), F.lit("KT"))


def _vis(vis):
    return F.lpad(F.when(vis < 9999, vis).when(vis >= 9999, 9999.0).cast("int").cast("string"), 4, "0")


def raw_observations(v):
    k = v.events.select(F.col("event_id").alias("obs_id"), "k")
    o = v.obs.join(k, "obs_id")
    clouds = (F.when(F.col("k") % 13 == 0, "VV001")
              .when(F.col("ceiling_ft").isNull(), "FEW020")
              .otherwise(F.concat(F.lit("SCT001 BKN"), _three(F.floor(F.col("ceiling_ft") / 100)),
                                  F.when(F.col("k") % 9 == 0, "CB").otherwise(""), F.lit(" OVC200"))))
    weather = F.when(F.col("k") % 4 == 0, "-RA ").when(F.col("k") % 4 == 1, "BR ").when(
        F.col("k") % 4 == 2, "+TSRA FG ").otherwise("")
    sky = F.when((F.col("vis_m") >= 9999) & (F.col("obs_id") % 2 == 1), "CAVOK").otherwise(
        F.concat(_vis(F.col("vis_m")), F.lit(" "), weather, clouds))
    signed = lambda t: F.concat(F.when(t < 0, "M").otherwise(""), _two(F.abs(t)))
    text = F.concat_ws(" ", F.lit("METAR"), "icao", F.concat(_stamp(F.col("observed_at")), F.lit("Z")),
                       _wind(F.col("wind_dir_deg"), F.col("wind_spd_kt"), F.col("wind_gust_kt")), F.lit("320V020"), sky,
                       F.concat(signed(F.col("temp_c")), F.lit("/"), signed(F.col("dewpoint_c"))),
                       F.concat(F.lit("Q"), F.lpad(F.col("qnh_hpa").cast("int").cast("string"), 4, "0")),
                       F.lit("TEMPO 0300 +SN OVC001 RMK 15/15 ="))
    return o.select(F.col("obs_id").alias("id"), "icao", "observed_at", text.alias("raw_text"), F.lit("iem").alias("source"))


_CEIL = "case when cavok then null when k%13=0 then 100 when ceiling_ft is not null then cast(floor(ceiling_ft/100) as integer)*100 end"
DECODED = f"""select *, case when ceil is null and vis is null then null when ceil < 500 or vis < 1600 then 'LIFR' when ceil < 1000 or vis < 4800 then 'IFR'
 when ceil < 3000 or vis < 8000 then 'MVFR' else 'VFR' end as cat from (select *, {_CEIL} as ceil from (
 select o.*, e.k, case when vis_m >= 9999 then 10000.0 else vis_m end as vis, vis_m >= 9999 and o.obs_id%2=1 as cavok from obs_v o join ev_v e on e.event_id = o.obs_id) x) y"""
DEC = {"decoded_v": DECODED}


def decoded_observations(v):
    return D.readable_observations(D.decode_observations(raw_observations(v)))


@register("decode_obs", """select obs_id, icao, date_trunc('minute', observed_at) as observed_at, wind_dir_deg, round(wind_spd_kt,6) as wind_spd_kt,
 round(wind_gust_kt,6) as wind_gust_kt, round(vis,6) as vis_m, round(temp_c,6) as temp_c, round(dewpoint_c,6) as dewpoint_c,
 round(qnh_hpa,6) as qnh_hpa, ceil as ceiling_ft, cat as flight_category from decoded_v""", DEC)
def decode_obs(v):
    return decoded_observations(v).drop("raw_metar_id", "clouds", "weather")


@register("decode_clouds", """select obs_id, l.cover, l.base_ft, l.cb from (select obs_id, unnest(case
 when k%13=0 or cavok then [] when ceiling_ft is null then [{'cover':'FEW','base_ft':2000,'cb':false}]
 else [{'cover':'SCT','base_ft':100,'cb':false}, {'cover':'BKN','base_ft':cast(floor(ceiling_ft/100) as integer)*100,'cb':k%9=0},
  {'cover':'OVC','base_ft':20000,'cb':false}] end) as l from decoded_v)""", DEC)
def decode_clouds(v):
    return decoded_observations(v).select("obs_id", F.explode("clouds").alias("l")).select("obs_id", "l.*")


@register("decode_weather", """select obs_id, case when cavok then '' when k%4=0 then '-RA' when k%4=1 then 'BR' when k%4=2 then '+TSRA FG' else '' end as weather from decoded_v""", DEC)
def decode_weather(v):
    return decoded_observations(v).select("obs_id", F.array_join("weather", " ").alias("weather"))


@register("weather_tokens", """select obs_id, case k%4 when 0 then '-' when 1 then '+' when 2 then 'VC' else '' end ||
 case when k%3=0 then 'SH' else '' end || 'RA' as token from decoded_v""", DEC)
def weather_tokens(v):
    k = F.col("k")
    word = F.when(k % 4 == 0, "LIGHT").when(k % 4 == 1, "HEAVY").when(k % 4 == 2, "IN_VICINITY")
    token = C.weather_token(word, F.when(k % 3 == 0, "SH"), F.lit("RA"))
    return v.events.select(F.col("event_id").alias("obs_id"), token.alias("token"))


@register("visibility_tokens", """select event_id, case when k%7=0 then round(k*1609.34::double,6) when k%7=1 then null when k%7=2 then 10000.0
 when k%7=3 then null else round(cast(k*100 as double),6) end as vis_m from ev_v""")
def visibility_tokens(v):
    k = F.col("k")
    token = (F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit("SM"))).when(k % 7 == 1, "1/2SM").when(k % 7 == 2, ">10000")
             .when(k % 7 == 3, " ").otherwise(F.concat(F.lit("<"), (k * 100).cast("string"))))
    return v.events.select("event_id", C.visibility_m(token).alias("vis_m"))


@register("wind_units", """select event_id, round(case k%4 when 0 then k*1.94384::double when 1 then k/1.852::double else cast(k as double) end,6) as kt,
 case when k%5=0 then null else k end as dir from ev_v""")
def wind_units(v):
    k = F.col("k")
    unit = F.when(k % 4 == 0, "mps").when(k % 4 == 1, "KMH").when(k % 4 == 2, "KT")
    token = F.when(k % 5 == 0, "VRB").otherwise(k.cast("string"))
    return v.events.select("event_id", C.knots(k, unit).alias("kt"), C.wind_direction(token).alias("dir"))


@register("resolve_time", """select event_id, case when abs(d1) < abs(d0) and abs(d1) <= abs(d2) then t1 when abs(d0) <= abs(d2) then t0 else t2 end as resolved
 from (select *, date_diff('microsecond', ts, t0) as d0, date_diff('microsecond', ts, t1) as d1, date_diff('microsecond', ts, t2) as d2 from (
 select event_id, ts, timestamp '2023-12-01' + to_days(cast(k%28 as integer)) + to_hours(h) as t0,
  timestamp '2024-01-01' + to_days(cast(k%28 as integer)) + to_hours(h) as t1,
  timestamp '2024-02-01' + to_days(cast(k%28 as integer)) + to_hours(h) as t2 from (select *, cast(event_id%25 as integer) as h from ev_v)))""")
def resolve_time_query(v):
    at = resolve_time(F.col("ts"), F.col("k") % 28 + 1, (F.col("event_id") % 25).cast("int"))
    return v.events.select("event_id", at.alias("resolved"))


def _segment(kind, start_end, d, s, vis, ceil):
    sky = F.concat_ws(" ", F.concat(F.coalesce(_three(d), F.lit("VRB")), _two(s), F.lit("KT")), _vis(vis),
                      F.concat(F.lit("BKN"), _three(ceil / 100)))
    return F.concat_ws(" ", kind, start_end, sky)


def raw_forecasts(v):
    """Messages made from the change groups, in message order."""
    g = v.groups
    span = F.concat(_hour(F.col("valid_from")), F.lit("/"), _hour(F.col("valid_to")))
    kind = (F.when(F.col("group_type") == "BASE", F.lit(None).cast("string"))
            .when(F.col("group_type") == "FM", F.concat(F.lit("FM"), _stamp(F.col("valid_from"))))
            .otherwise(F.translate("group_type", "_", " ")))
    text = _segment(kind, F.when(~F.col("group_type").isin("BASE", "FM"), span), F.col("wind_dir_deg"),
                    F.col("wind_spd_kt"), F.col("vis_m"), F.col("ceiling_ft"))
    parts = g.groupBy("taf_id").agg(F.array_sort(F.collect_list(F.struct("group_seq", text.alias("t")))).alias("parts"))
    head = F.concat_ws(" ", F.lit("TAF"), "icao", F.concat(_stamp(F.col("issued_at")), F.lit("Z")),
                       F.concat(_hour(F.col("valid_from")), F.lit("/"), _hour(F.col("valid_to"))))
    return (v.taf.join(parts, "taf_id")
            .select(F.col("taf_id").alias("id"), "icao", "issued_at",
                    F.concat(F.concat_ws(" ", head, F.array_join(F.transform("parts", lambda p: p["t"]), "\n  ")), F.lit("="))
                    .alias("raw_text"), F.lit("ogimet").alias("source")))


@register("decode_forecasts", "select taf_id, icao, issued_at, valid_from, valid_to from taf_v")
def decode_forecasts(v):
    return D.forecast_headers(D.split_forecasts(raw_forecasts(v))).drop("raw_taf_id")


@register("decode_forecast_groups", """select taf_id, group_seq, group_type, probability, valid_from, valid_to, wind_dir_deg,
 round(wind_spd_kt,6) as wind_spd_kt, round(case when vis_m >= 9999 then 10000.0 else vis_m end,6) as vis_m, ceiling_ft, flight_category from group_v""")
def decode_forecast_groups(v):
    return D.forecast_groups(D.split_forecasts(raw_forecasts(v))).drop("wind_gust_kt", "clouds", "weather")


@register("unreadable_messages", "select event_id as id from ev_v where k%10=3")
def unreadable_messages(v):
    """Messages without a station or validity are set apart, the others decode."""
    raw = v.events.select(F.col("event_id").alias("id"), F.col("ts").alias("issued_at"),
                          F.when(F.col("k") % 10 == 3, F.concat(F.lit("NIL "), F.col("icao"))).otherwise(
                              F.concat(F.lit("TAF "), F.col("icao"), F.lit(" 011100Z 0112/0218 22012KT 9999"))).alias("raw_text"))
    good = D.forecast_headers(D.split_forecasts(raw)).select(F.col("taf_id").alias("id"))
    return raw.select("id").join(good, "id", "left_anti")


# --- feeds ------------------------------------------------------------------

@register("csv_scan", """select icao, date_trunc('minute', ts) as observed_at, 'METAR ' || icao || ' ' || k as raw_text, 'iem' as source from ev_v
 where k%11<>0 and k%13<>0 and date_trunc('minute', ts) >= '2024-01-05' and date_trunc('minute', ts) < '2024-01-25'""")
def csv_scan(v):
    line = F.concat_ws(",", "icao", F.when(F.col("k") % 13 == 0, "M").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")),
                       F.when(F.col("k") % 11 == 0, " ").otherwise(F.concat(F.lit(" METAR "), "icao", F.lit(" "), "k")))
    rows = v.events.select(F.from_csv(line, feeds.OBSERVATION_CSV).alias("r")).select("r.*")
    return feeds.shape_observations(rows, "2024-01-05", "2024-01-25")


_BULK = "select {cols} from ev_v where icao in ('ST03','ST11') and k%9<>0 and ts >= '2024-01-05'"


def _bulk_lines(v):
    line = F.concat_ws(",", "icao", F.when(F.col("k") % 9 == 0, "ANO").otherwise(F.date_format("ts", "yyyy")), F.date_format("ts", "MM"),
                       F.date_format("ts", "dd"), F.date_format("ts", "HH"), F.date_format("ts", "mm"),
                       F.concat(F.lit("TAF "), "icao", F.lit(" "), "k", F.lit(" ==")))
    return v.events.select(F.from_csv(line, feeds.BULK_CSV).alias("r"), "ts").select("r.*", "ts")


def _bulk_rows(v):
    return feeds.shape_bulk(_bulk_lines(v), ["ST03", "ST11"], "2024-01-05", "2024-02-05")


@register("bulk_scan_forecasts", _BULK.format(cols="""icao, date_trunc('minute', ts) as issued_at, cast(null as timestamp) as valid_from,
 cast(null as timestamp) as valid_to, 'TAF ' || icao || ' ' || k as raw_text, 'ogimet' as source"""))
def bulk_scan_forecasts(v):
    return feeds.bulk_forecasts(_bulk_rows(v))


@register("bulk_scan_observations", _BULK.format(cols="icao, date_trunc('minute', ts) as observed_at, 'TAF ' || icao || ' ' || k as raw_text, 'ogimet' as source"))
def bulk_scan_observations(v):
    return feeds.bulk_observations(_bulk_rows(v))


@register("granule_audit", """select granule, count(*) as n_lines, bool_or(k%2=0 and m%2=0) as has_taf, count(*)>1 and bool_or(k%2=0 and m%2=0) as keep
 from (select k, cast(user_id%7 as integer) as m, 'ST' || (user_id%7) as granule from ev_v) group by 1""")
def granule_audit(v):
    m = F.col("user_id") % 7
    lines = v.events.select(F.concat(F.lit("ST"), m.cast("string")).alias("granule"),
                            F.when((F.col("k") % 2 == 0) & (m % 2 == 0), "TAF x").otherwise("METAR x").alias("value"))
    return feeds.granule_audit(lines)


@register("station_prefixes", "select upper(substr(lower(icao),1,2)) as prefix, cast(year(ts) as integer) as year, count(*) as n from ev_v group by all")
def station_prefixes(v):
    return v.events.groupBy(feeds.icao_prefix(F.lower("icao")).alias("prefix"), F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register("granule_scan", _BULK.format(cols="""icao, date_trunc('minute', ts) as issued_at, cast(null as timestamp) as valid_from,
 cast(null as timestamp) as valid_to, 'TAF ' || icao || ' ' || k as raw_text, 'ogimet' as source"""))
def granule_scan(v):
    """All stations' granules written in their folders, two stations' read back."""
    root = f"{checkpoint_folder(v.spark)}/granules-{uuid.uuid4().hex}"
    (_bulk_lines(v).withColumn("prefix", feeds.icao_prefix(F.col("station"))).withColumn("row_year", F.col("year"))
     .withColumn("year", F.year("ts")).select("station", "row_year", "month", "day", "hour", "minute", "report", "prefix", "year")
     .write.partitionBy("prefix", "year").csv(root))
    return feeds.bulk_forecasts(feeds.read_granules(v.spark, root, ["ST03", "ST11"], "2024-01-05", "2024-02-05"))


# --- stored tables ----------------------------------------------------------

_RAW_KEYS = "select 'raw_metar' as name, count(*) as first, 0 as second, count(*) as stored from (select distinct icao, observed_at from obs_v)"


@register("stored_twice", _RAW_KEYS + """
 union all select 'raw_taf', count(*), 0, count(*) from (select distinct icao, issued_at from taf_v)
 union all select 'nwp_point', count(*), 0, count(*) from (select distinct icao, valid_time, source from nwp_v)
 union all select 'expected_hour', count(*), 0, count(*) from expected_v
 union all select 'verification_hourly', count(*), 0, count(*) from scored_v""")
def stored_twice(v):
    """Every sink run twice over the same rows: what each run added, and what is stored. Then all scores are replaced by themselves."""
    root = f"{checkpoint_folder(v.spark)}/store-{uuid.uuid4().hex}"
    metar = v.obs.select("icao", "observed_at", F.concat(F.lit("METAR "), "icao").alias("raw_text"), F.lit("iem").alias("source"))
    taf = v.taf.select("icao", "issued_at", "valid_from", "valid_to", F.concat(F.lit("TAF "), "icao").alias("raw_text"), F.lit("ogimet").alias("source"))
    sinks = {"raw_metar": lambda p: T.store_raw(metar, p, "raw_metar", dedup_batch=True),
             "raw_taf": lambda p: T.store_raw(taf, p, "raw_taf", dedup_batch=True), "nwp_point": lambda p: T.store_nwp(v.nwp, p),
             "expected_hour": lambda p: T.store_expected_hours(v.expected, p), "verification_hourly": lambda p: T.store_verification(v.scored, p)}
    rows = []
    for name, sink in sinks.items():
        path = f"{root}/{name}"
        added = [sink(path), sink(path)]
        if name == "verification_hourly":
            T.replace_verification(v.scored, path)
        rows.append((name, *added, v.spark.read.parquet(path).count()))
    return v.spark.createDataFrame(rows, "name string, first long, second long, stored long")


@register("dated_append", """select obs_id, icao, observed_at, source from (select *, row_number() over (partition by icao, observed_at, source order by obs_id%3) as rn
 from (select obs_id, icao, observed_at, case when obs_id%7=0 then null else 'iem' end as source from obs_v)) where rn = 1""")
def dated_append(v):
    """Three overlapping batches and a repeat into a table by day; the last one's digests are there, its rows are not."""
    table = DatedTable(v.spark, f"{checkpoint_folder(v.spark)}/dated-{uuid.uuid4().hex}", ["icao", "observed_at", "source"], day_of(F.col("observed_at")))
    rows = v.obs.select("obs_id", "icao", "observed_at", F.when(F.col("obs_id") % 7 != 0, "iem").alias("source"))
    for k in (0, 1, 0, 2):
        part = rows.filter(F.col("obs_id") % 3 == k)
        if k == 2:
            table._write(part.select(table.day.alias("day"), F.xxhash64(*table.keys).alias("_d")), f"{table.path}_keys", ["day"], "append")
        table.append(part, dedup_batch=True)
    return table.read().drop("day")


@register("dated_pending", "select event_id as id, icao from ev_v where k%4 <> 0 or (date_trunc('day', ts) < '2024-01-11' and k%4 = 0 and event_id%50 = 0)")
def dated_pending(v):
    """Raw rows without a decoded one, from the days that lack some: in a few days all but every fiftieth are decoded."""
    root = f"{checkpoint_folder(v.spark)}/pending-{uuid.uuid4().hex}"
    day = day_of(F.col("ts"))
    raw = DatedTable(v.spark, f"{root}/raw", ["id"], day)
    done = DatedTable(v.spark, f"{root}/done", ["raw_id"], F.col("raw_day"))
    raw.append(v.events.select(F.col("event_id").alias("id"), "icao", "ts"))
    done.append(v.events.filter("k % 4 = 0 and not (ts < '2024-01-11' and event_id % 50 = 0)")
                .select(F.col("event_id").alias("raw_id"), day.alias("raw_day")))
    return pending(raw, done, "raw_id", "raw_day").select("id", "icao")


def _scored_store(v, forecasts) -> Store:
    store = Store(v.spark, f"{checkpoint_folder(v.spark)}/rescore-{uuid.uuid4().hex}")
    store.append("taf_forecast", forecasts.withColumn("raw_taf_id", F.col("taf_id")))
    store.append("taf_group", v.groups)
    store.append("metar_obs", v.obs.withColumn("raw_metar_id", F.col("obs_id")))
    return store


@register("rescored", """select taf_id, valid_hour, scoring_profile, category_outcome, round(fcst_prob,6) as fcst_prob, round(vis_err_m,6) as vis_err_m
 from verif_v where scoring_profile <> 'climatology'""")
def rescored(v):
    """Scores stored from cut observations, then every profile scored again over all of them."""
    store = _scored_store(v, v.taf)
    wrong = v.verification.filter("scoring_profile <> 'climatology' and taf_id % 2 = 0").withColumn("category_outcome", F.lit("?"))
    store.append("verification_hourly", wrong)
    rescore(store, ["categorical", "persistence"])
    return store.read("verification_hourly").select("taf_id", "valid_hour", "scoring_profile", "category_outcome", "fcst_prob", "vis_err_m")


@register("keyed_append", """select obs_id, icao, observed_at, source from (select obs_id, icao, observed_at, case when obs_id%3=0 then null else 'iem' end as source from obs_v) o
 where not exists (select 1 from obs_v s where s.obs_id%2=0 and s.icao = o.icao and s.observed_at = o.observed_at and
  (case when s.obs_id%3=0 then null else 'iem' end) is not distinct from o.source)""")
def keyed_append(v):
    rows = v.obs.select("obs_id", "icao", "observed_at", F.when(F.col("obs_id") % 3 != 0, "iem").alias("source"))
    return T.not_stored(rows, rows.filter("obs_id % 2 = 0"), ["icao", "observed_at", "source"])


@register("pending_decode", "select event_id as id, icao from ev_v where k%4 <> 0")
def pending_decode(v):
    raw = v.events.select(F.col("event_id").alias("id"), "icao")
    done = v.events.filter("k % 4 = 0").select(F.col("event_id").alias("raw_metar_id"))
    return T.undecoded(raw, done, "raw_metar_id")


@register("station_upsert", """select icao, case when cast(substr(icao,3) as integer)%2=0 then 'new ' || name else name end as name,
 case when cast(substr(icao,3) as integer)%2=0 then elevation_m + 1 else elevation_m end as elevation_m from station_v""")
def station_upsert(v):
    old = v.stations.select("icao", "name", "elevation_m")
    new = old.filter(F.substring("icao", 3, 2).cast("int") % 2 == 0).select(
        "icao", F.concat(F.lit("new "), "name").alias("name"), (F.col("elevation_m") + 1).alias("elevation_m"))
    return T.upsert(new, old, "icao")


@register("json_round_trip", """select obs_id, case when k%13=0 or cavok then 0 when ceiling_ft is null then 1 else 3 end as layers from decoded_v""", DEC)
def json_round_trip(v):
    text = D.encode_nested(decoded_observations(v).select("obs_id", "clouds"), "clouds")
    back = D.decode_nested(text, {"clouds": "array<struct<cover:string,base_ft:int,cb:boolean>>"})
    return back.select("obs_id", F.size("clouds").alias("layers"))


@register("verification_pending_rows", "select taf_id, valid_hour from scored_v where taf_id%3<>0")
def verification_pending_rows(v):
    return T.not_stored(v.scored, v.scored.filter("taf_id % 3 = 0"),
                        T.TABLE_KEYS["verification_hourly"]).select("taf_id", "valid_hour")


# --- gridded model input ----------------------------------------------------

_POINT = """{icao}, {time} as valid_time, 'era5' as source, round(sqrt(u10*u10+v10*v10)*1.94384::double,6) as wind10m_spd,
 round(case when degrees(atan2(-u10,-v10)) < 0 then degrees(atan2(-u10,-v10))+360 else degrees(atan2(-u10,-v10)) end,6) as wind10m_dir,
 round(fg10*1.94384::double,6) as gust, round(t2m-273.15::double,6) as t2m_c, round(case when isnan(d2m) then null else d2m-273.15::double end,6) as d2m_c,
 round(tcc,6) as tcc, cast(null as double) as lcc, cast(null as double) as mcc, cast(null as double) as hcc, round(cbh,6) as cbh_m,
 round(tp*1000,6) as tp_mm, round(msl/100,6) as mslp_hpa"""


@register("nwp_point", "select " + _POINT.format(icao="'G' || cast(cast(latitude*10 as integer) as varchar) || cast(cast(longitude as integer) as varchar) as icao", time="time") + " from grid_v")
def nwp_point(v):
    name = F.concat(F.lit("G"), (F.col("latitude") * 10).cast("int").cast("string"), F.col("longitude").cast("int").cast("string"))
    return G.point_records(v.grid.withColumn("icao", name))


_CELLS = """select icao, (select latitude from (select distinct latitude from grid_v) g order by abs(latitude-lat), latitude desc limit 1) as latitude,
 (select longitude from (select distinct longitude from grid_v) g order by abs(longitude-lon), longitude desc limit 1) as longitude from station_v"""


@register("station_cells", "select icao, round(latitude,6) as latitude, round(longitude,6) as longitude from cells_v", {"cells_v": _CELLS})
def station_cells(v):
    return G.station_cells(v.grid, v.stations)


@register("nearest_grid", "select " + _POINT.format(icao="icao", time="time") + " from grid_v g join cells_v c on c.latitude = g.latitude and c.longitude = g.longitude", {"cells_v": _CELLS})
def nearest_grid(v):
    return G.extract_points(v.grid, v.stations)


@register("merge_streams", """select time, latitude, longitude, round(coalesce(a.t2m, b.t2m + 1),6) as t2m, round(a.u10,6) as u10, round(b.tp,6) as tp
 from (select * from grid_v where cast(t2m as integer)%3<>0) a full join (select * from grid_v where cast(cbh as integer)%4<>0) b using (time, latitude, longitude)""")
def merge_streams(v):
    keys = ["time", "latitude", "longitude"]
    first = v.grid.filter("cast(t2m as int) % 3 <> 0").select(*keys, "t2m", "u10")
    second = v.grid.filter("cast(cbh as int) % 4 <> 0").select(*keys, (F.col("t2m") + 1).alias("t2m"), "tp")
    return G.merge_streams(first, second)


@register("point_series", "select icao, valid_time, round(t2m_c,6) as t2m_c, cast(null as double) as tcc from (select icao, valid_time, k%30+270-273.15::double as t2m_c from "
          "(select icao, date_trunc('hour',ts) as valid_time, max(k) as k from ev_v group by all))")
def point_series(v):
    points = v.nwp.select("icao", "valid_time", (F.col("t2m_c") + 270).alias("t2m"))
    return G.point_records(points).select("icao", "valid_time", "t2m_c", "tcc")
