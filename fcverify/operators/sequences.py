"""Hourly station states and the past / future windows of sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions.conditions import category_rank, day_cycle, sin_cos_known
from fcverify.functions.sampling import issue_hour_percent, keep_percent, split_name
from fcverify.functions.timetokens import hour_floor
from fcverify.operators.asof import asof_keys
from fcverify.operators.features import NWP_USED, STATE_NOW
from fcverify.operators.nearest import nearest_by_hour
from fcverify.schema import ANCHOR_MAX_AGE_H, HORIZON, NO_CEILING_FT, PAST_LEN, SEQUENCE_TOLERANCE_S
from fcverify.session import checkpoint

PAST_FEATURES = ("vis", "ceiling", "has_ceiling", "wspd", "wdir_sin", "wdir_cos", "spread", "temp", "cat_code", "fresh")
COVARIATES = ("et_wspd", "et_wdir_sin", "et_wdir_cos", "et_gust", "et_t2m", "et_spread", "et_tcc", "et_cbh",
              "et_tp", "et_msl")
CYCLES = ("hod_sin", "hod_cos", "doy_sin", "doy_cos")
TARGETS = ("vis", "ceiling", "wspd", "wdir_sin", "wdir_cos")

# Hours per window block at least. No shorter than a window, so a row is copied to at most one more block.
BLOCK_HOURS = 720


def hourly_axis(obs: DataFrame) -> DataFrame:
    """Every whole hour from a station's first to its last observation.

    One row per calendar hour and station, however many observations there are.
    """
    span = obs.filter(F.col("observed_at").isNotNull()).groupBy("icao").agg(
        hour_floor(F.min("observed_at")).alias("first_hour"), hour_floor(F.max("observed_at")).alias("last_hour"))
    return span.withColumn("hour", F.explode(F.sequence("first_hour", "last_hour", F.expr("interval 1 hour"))))


def _circle(name: str, degrees: Column) -> list[Column]:
    return sin_cos_known(name, degrees)[:2]


def _number(value: Column) -> Column:
    return value.cast("double")


def _ceiling(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(NO_CEILING_FT)))


def _encoder_columns(s: Column) -> list[Column]:
    """The encoder's columns from the last observation ``s`` at or before ``hour``."""
    age = F.unix_micros("hour") - F.unix_micros(s["matched_at"])
    return [
        _number(s["vis_m"]).alias("vis"), _ceiling(s["ceiling_ft"]).alias("ceiling"),
        s["ceiling_ft"].isNotNull().cast("double").alias("has_ceiling"), _number(s["wind_spd_kt"]).alias("wspd"),
        *_circle("wdir", s["wind_dir_deg"]), (_number(s["temp_c"]) - _number(s["dewpoint_c"])).alias("spread"),
        _number(s["temp_c"]).alias("temp"), _number(category_rank(s["flight_category"])).alias("cat_code"),
        F.coalesce(age <= ANCHOR_MAX_AGE_H * 3_600_000_000, F.lit(False)).cast("double").alias("fresh")]


def _target_columns(o: Column) -> list[Column]:
    """The targets from the nearest observation ``o``; ``has_obs`` is the mask."""
    return [
        _number(o["vis_m"]).alias("vis"), _ceiling(o["ceiling_ft"]).alias("ceiling"),
        _number(o["wind_spd_kt"]).alias("wspd"), *_circle("wdir", o["wind_dir_deg"]),
        category_rank(o["flight_category"]).alias("cat_code"),
        o["flight_category"].isNotNull().cast("int").alias("has_obs")]


def _covariate_columns(m: Column) -> list[Column]:
    """Model fields ``m`` and cyclical time of ``hour``."""
    return [
        m["wind10m_spd"].alias("et_wspd"), *_circle("et_wdir", m["wind10m_dir"]),
        m["gust"].alias("et_gust"), m["t2m_c"].alias("et_t2m"), (m["t2m_c"] - m["d2m_c"]).alias("et_spread"),
        m["tcc"].alias("et_tcc"), m["cbh_m"].alias("et_cbh"), m["tp_mm"].alias("et_tp"),
        m["mslp_hpa"].alias("et_msl"), *day_cycle("", F.col("hour"))]


def _model_fields(nwp: DataFrame, source: str) -> DataFrame:
    """(icao, hour, m): the model fields of one source."""
    return nwp.filter(F.col("source") == source).select(
        "icao", F.col("valid_time").alias("hour"), F.struct(*[_number(F.col(f)).alias(f) for f in NWP_USED]).alias("m"))


def encoder_state(axis: DataFrame, obs: DataFrame) -> DataFrame:
    """Last known state of every axis hour, with a flag for a recent observation.

    The first hour has no state if the first observation falls inside it.
    """
    return asof_keys(axis, obs, "hour", STATE_NOW, into="s").select("icao", "hour", *_encoder_columns(F.col("s")))


def target_state(axis: DataFrame, obs: DataFrame) -> DataFrame:
    """State observed within half an hour of every axis hour; ``has_obs`` is the mask."""
    near = nearest_by_hour(obs, [c for c in STATE_NOW], tolerance_s=SEQUENCE_TOLERANCE_S)
    rows = axis.select("icao", "hour").join(near.withColumnRenamed("valid_hour", "hour"), ["icao", "hour"], "left")
    return rows.select("icao", "hour", *_target_columns(F.col("obs")))


def covariates(axis: DataFrame, nwp: DataFrame, source: str = "era5") -> DataFrame:
    """Model fields and cyclical time of every axis hour."""
    rows = axis.select("icao", "hour").join(_model_fields(nwp, source), ["icao", "hour"], "left")
    return rows.select("icao", "hour", *_covariate_columns(F.col("m")))


def station_hours(obs: DataFrame, nwp: DataFrame, source: str = "era5") -> DataFrame:
    """(icao, hour) with structs ``past``, ``ahead`` and ``target`` and the axis ends, in one grouped pass.

    Every observation goes to the hour it lies in, which it may be nearest to, and to the next one, whose state it may
    be; model rows go to their hour. One aggregate by station and hour folds them. What is left has at most one row
    a station and calendar hour; over these the state is carried forward, and hours without any row are put in.
    """
    time, hour = F.col("observed_at"), hour_floor(F.col("observed_at"))
    following = F.when(time == hour, hour).otherwise(hour + F.expr("interval 1 hour"))
    gap = F.abs(F.unix_micros(time) - F.unix_micros("hour"))
    state = F.struct(time.alias("matched_at"), *STATE_NOW)
    seen = (obs.filter(time.isNotNull()).select("icao", "obs_id", "observed_at", hour.alias("_own"), state.alias("s"),
                                                F.explode(F.array_distinct(F.array(hour, following))).alias("hour"))
            .select("icao", "hour", "s", F.lit(None).cast(_model_fields(nwp, source).schema["m"].dataType).alias("m"), F.col("_own"),
                    F.when(time <= F.col("hour"), F.struct(time, "obs_id")).alias("_upto"),
                    F.when(gap <= SEQUENCE_TOLERANCE_S * 1_000_000, F.struct(gap, -F.unix_micros(time), -F.col("obs_id"))).alias("_near")))
    none = lambda c: F.lit(None).cast(seen.schema[c].dataType).alias(c)
    model = _model_fields(nwp, source).select("icao", "hour", none("s"), "m", none("_own"), none("_upto"), none("_near"))
    folded = seen.unionByName(model).groupBy("icao", "hour").agg(
        F.max_by("s", "_upto").alias("s"), F.min_by("s", "_near").alias("o"), F.max("m").alias("m"),
        F.min("_own").alias("_lo"), F.max("_own").alias("_hi"))
    whole = Window.partitionBy("icao")
    order = whole.orderBy("hour")
    carried = (folded.withColumns({
        "first_hour": F.min("_lo").over(whole), "last_hour": F.max("_hi").over(whole),
        "s": F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        .filter(F.col("hour").between(F.col("first_hour"), F.col("last_hour")))
        .withColumn("_next", F.lead("hour").over(order)))
    until = F.coalesce(F.col("_next") - F.expr("interval 1 hour"), F.col("hour"))
    rows = carried.select("icao", "first_hour", "last_hour", "s", "o", "m", F.posexplode(F.sequence("hour", until, F.expr("interval 1 hour"))).alias("_k", "hour"))
    own = lambda c: F.when(F.col("_k") == 0, F.col(c)).alias(c)
    rows = rows.select("icao", "hour", "first_hour", "last_hour", "s", own("o"), own("m"))
    keys = ["icao", "hour", "first_hour", "last_hour"]
    rows = rows.select(*keys, F.struct(*_encoder_columns(F.col("s"))).alias("e"), F.struct(*_target_columns(F.col("o"))).alias("t"),
                       F.struct(*_covariate_columns(F.col("m"))).alias("c"))
    known = lambda struct, names: F.struct(*[F.coalesce(F.nanvl(F.col(f"{struct}.{n}"), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names])
    return rows.select(
        *keys, known("e", PAST_FEATURES).alias("past"), known("c", COVARIATES + CYCLES).alias("ahead"),
        F.struct(*[F.coalesce(F.col(f"t.{n}"), F.lit(0.0)).alias(n) for n in TARGETS],
                 F.when(F.col("t.has_obs") == 1, F.col("t.cat_code")).otherwise(-1).alias("cat"), F.col("t.has_obs").alias("mask")).alias("target"),
        F.col("e.fresh").alias("fresh"))


def issue_hours(hours: DataFrame, past_len: int = PAST_LEN, horizon: int = HORIZON,
                sample_pct: int | None = None) -> DataFrame:
    """Axis hours that can be an issue time: fresh, with a full past and future."""
    step = 3600
    behind = (F.unix_seconds("hour") - F.unix_seconds("first_hour")) / step
    ahead = (F.unix_seconds("last_hour") - F.unix_seconds("hour")) / step
    length = (F.unix_seconds("last_hour") - F.unix_seconds("first_hour")) / step + 1
    full = (behind >= past_len - 1) & (ahead >= horizon) & (length >= past_len + horizon + 1)
    return keep_percent(hours.filter(full & (F.col("fresh") == 1.0)), issue_hour_percent(F.col("hour")), sample_pct)


def sequence_windows(obs: DataFrame, nwp: DataFrame, stations: DataFrame, past_len: int = PAST_LEN,
                     horizon: int = HORIZON, sample_pct: int | None = None, icaos=None) -> DataFrame:
    """One row per (station, issue hour) with past, future and target arrays.

    Rows are cut in blocks of hours with an overlap of one window, so that a
    station's history is spread over tasks; every issue hour is answered in the
    block it lies in.
    """
    return windows_of(_hours(obs, nwp, stations, icaos), stations, past_len, horizon, sample_pct)


def _hours(obs: DataFrame, nwp: DataFrame, stations: DataFrame, icaos=None) -> DataFrame:
    if icaos is not None:
        obs = obs.filter(F.col("icao").isin(*icaos))
    return station_hours(obs.join(stations.select("icao"), "icao", "left_semi"), nwp)


def windows_of(hours: DataFrame, stations: DataFrame, past_len: int = PAST_LEN, horizon: int = HORIZON,
               sample_pct: int | None = None) -> DataFrame:
    """The windows over ``station_hours``."""
    block_hours = max(BLOCK_HOURS, past_len + horizon)
    hours = hours.withColumn("_i", F.floor(F.unix_seconds("hour") / F.lit(3600)))
    block = lambda i: F.floor(i / F.lit(block_hours))
    blocks = F.array_distinct(F.array(block(F.col("_i") - horizon), block(F.col("_i") + past_len - 1), block(F.col("_i"))))
    spread = hours.withColumn("_block", F.explode(blocks))
    order = Window.partitionBy("icao", "_block").orderBy("_i")
    windows = (
        spread
        .withColumn("_past", F.collect_list("past").over(order.rowsBetween(-(past_len - 1), 0)))
        .withColumn("_next", F.collect_list(F.struct("ahead", "target")).over(order.rowsBetween(1, horizon)))
        .filter(F.col("_block") == block(F.col("_i")))
    )
    kept = issue_hours(windows, past_len, horizon, sample_pct)
    place = stations.select("icao", F.array(*[F.col(c).cast("float") for c in ("lat", "lon", "elevation_m")])
                            .alias("x_static"))
    floats = lambda s, names: [s[n].cast("float") for n in names]
    # Stated as a condition too, so that a later filter on an element cannot be
    # evaluated on the short windows that are being filtered out here.
    whole = (F.size("_past") == past_len) & (F.size("_next") == horizon)
    arrays = {
        "x_past": F.transform("_past", lambda p: F.array(*floats(p, PAST_FEATURES))),
        "x_future": F.transform("_next", lambda n, k: F.array(
            *floats(n["ahead"], COVARIATES), (k + 1).cast("float"), *floats(n["ahead"], CYCLES))),
        "y_reg": F.transform("_next", lambda n: F.array(*floats(n["target"], TARGETS))),
        "y_cat": F.transform("_next", lambda n: n["target"]["cat"].cast("long")),
        "y_mask": F.transform("_next", lambda n: n["target"]["mask"].cast("float")),
    }
    built = {name: F.when(whole, array).alias(name) for name, array in arrays.items()}
    return kept.join(place, "icao").select(
        "icao", F.col("hour").alias("t0"), built["x_past"], built["x_future"], "x_static",
        built["y_reg"], built["y_cat"], built["y_mask"])


def station_ids(obs: DataFrame, nwp: DataFrame, stations: DataFrame, past_len: int = PAST_LEN,
                horizon: int = HORIZON, sample_pct: int | None = None) -> DataFrame:
    """(icao, station_id): stations that have sequences, numbered in code order."""
    return _numbered(_hours(obs, nwp, stations), past_len, horizon, sample_pct)


def _numbered(hours: DataFrame, past_len: int, horizon: int, sample_pct: int | None) -> DataFrame:
    """Found on the hours without building windows. The numbering runs over the station list only."""
    have = issue_hours(hours, past_len, horizon, sample_pct).select("icao").distinct()
    return have.withColumn("station_id", (F.row_number().over(Window.orderBy("icao")) - 1).cast("long"))


def build_sequences(obs: DataFrame, nwp: DataFrame, stations: DataFrame, past_len: int = PAST_LEN,
                    horizon: int = HORIZON, sample_pct: int | None = None) -> DataFrame:
    """Windows of all stations with their integer station id; the hours are made once for both."""
    hours = checkpoint(_hours(obs, nwp, stations))
    return windows_of(hours, stations, past_len, horizon, sample_pct).join(_numbered(hours, past_len, horizon, sample_pct), "icao")


def split_sequences(sequences: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    return sequences.withColumn("split", split_name(F.col("t0"), train_end, validation_end))
