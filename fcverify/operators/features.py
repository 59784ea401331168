"""Causal feature frame: nothing after the issue time enters a feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.conditions import day_cycle, sin_cos_known
from fcverify.functions.sampling import hash_percent, keep_percent
from fcverify.functions.timetokens import hour_boundaries, hour_floor
from fcverify.operators.asof import asof_lags
from fcverify.schema import ANCHOR_MAX_AGE_H, LAGS_H, LEADS_H, NO_CEILING_FT

NWP_USED = ("wind10m_spd", "wind10m_dir", "gust", "t2m_c", "d2m_c", "tcc", "cbh_m", "tp_mm", "mslp_hpa")
STATE_NOW = ("vis_m", "ceiling_ft", "wind_spd_kt", "wind_dir_deg", "temp_c", "dewpoint_c", "flight_category")
STATE_USED = ("vis_m", "ceiling_ft", "wind_spd_kt", "wind_dir_deg", "temp_c", "dewpoint_c")
STATE_LAGGED = ("vis_m", "ceiling_ft", "wind_spd_kt", "temp_c", "dewpoint_c")


def time_window(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Half-open window; a bound that is not given is not applied. Naive means UTC."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end).cast("timestamp"))
    return df


def station_filter(df: DataFrame, icaos: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the listed stations; a DataFrame of stations is applied as a semi join."""
    if icaos is None:
        return df
    if isinstance(icaos, DataFrame):
        return df.join(icaos.select("icao"), "icao", "left_semi")
    return df.filter(F.col("icao").isin(*icaos))


def _nwp_at(nwp: DataFrame, prefix: str, time_name: str, source: str = "era5") -> DataFrame:
    return nwp.filter(F.col("source") == source).select(
        "icao", F.col("valid_time").alias(time_name),
        F.struct(*[F.col(f).cast("double").alias(f) for f in NWP_USED]).alias(prefix))


def _issue_state(grid: DataFrame, obs: DataFrame, nwp: DataFrame) -> DataFrame:
    """What is known at each distinct (icao, t0) with a fresh observation: features of the state now and of lagged
    states, model at t0.

    Built once per issue time, not once per lead, which is the smaller side by the
    number of leads and valid hours that share the issue time. Features are plain columns
    from here on, so a column that is not asked for is not shuffled.
    """
    known = fresh(asof_lags(grid, obs, "t0", (0, *LAGS_H), STATE_USED))
    known = known.select("icao", "t0", F.col("lag_0.matched_at").alias("o0_time"), *state_exprs())
    return (known.withColumn("_h0", hour_floor(F.col("t0")))
            .join(_nwp_at(nwp, "e0", "_h0"), ["icao", "_h0"], "left").drop("_h0"))


def _raw(grid: DataFrame, issues: DataFrame, obs: DataFrame, nwp: DataFrame, stations: DataFrame) -> DataFrame:
    """``issues`` has the (icao, t0) of ``grid``, before anything was joined to it.

    Both sides of the join grow with the observations times the leads and are never broadcast: the planner takes
    rows that multiply by lead for as few as they were.
    """
    places = stations.select("icao", "region", "elevation_m", "lat", "lon")
    return grid.join(_issue_state(issues, obs, nwp).hint("merge"), ["icao", "t0"]).join(places, "icao")


def target_grid(obs: DataFrame, leads: Sequence[int] = LEADS_H, start=None, end=None,
                icaos=None, sample_pct: int | None = None, percent: Column | None = None) -> DataFrame:
    """Targets and their issue times. Window, stations and sample are applied to the
    observations, before each of them becomes one row per lead."""
    percent = hash_percent(F.col("observed_at")) if percent is None else percent
    targets = station_filter(time_window(obs, "observed_at", start, end), icaos)
    targets = keep_percent(targets, percent, sample_pct)
    return targets.select(
        "icao", "obs_id", F.col("observed_at").alias("valid_time"),
        F.struct(F.col("vis_m").cast("double").alias("vis_m"),
                 F.col("ceiling_ft").cast("double").alias("ceiling_ft"),
                 F.col("wind_spd_kt").cast("double").alias("wspd"),
                 F.col("wind_dir_deg").cast("double").alias("wdir"),
                 F.col("flight_category").alias("cat")).alias("_y"))


def _with_leads(targets: DataFrame, leads: Sequence[int]) -> DataFrame:
    return (targets.withColumn("lead_h", F.explode(F.array(*[F.lit(int(h)) for h in leads])))
            .withColumn("t0", F.col("valid_time") - F.make_dt_interval(F.lit(0), F.col("lead_h"))))


def training_samples(obs: DataFrame, nwp: DataFrame, stations: DataFrame,
                     leads: Sequence[int] = LEADS_H, start=None, end=None, icaos=None,
                     sample_pct: int | None = None, percent: Column | None = None) -> DataFrame:
    """Feature rows with targets for every observation and lead.

    The model fields of the valid hour are joined before the rows multiply by lead. Rows multiply behind a shuffle
    (so the model fields are not broadcast), by as many tasks as that has and not by the few that read the files.
    """
    targets = target_grid(obs, leads, start, end, icaos, sample_pct, percent)
    issues = _with_leads(targets.select("icao", "valid_time").distinct(), leads)
    targets = (targets.withColumn("_h", hour_floor(F.col("valid_time")))
               .join(_nwp_at(nwp, "et", "_h").hint("merge"), ["icao", "_h"], "left").drop("_h"))
    return engineer(_raw(_with_leads(targets, leads), issues, obs, nwp, stations), targets=True)


def request_features(requests: DataFrame, obs: DataFrame, nwp: DataFrame,
                     stations: DataFrame) -> DataFrame:
    """The same features for explicit (icao, t0, valid_time) requests, without targets.

    The lead is the number of hour marks between issue and validity.
    """
    grid = (requests.withColumn("lead_h", hour_boundaries(F.col("t0"), F.col("valid_time")))
            .withColumn("_h", hour_floor(F.col("valid_time")))
            .join(_nwp_at(nwp, "et", "_h"), ["icao", "_h"], "left").drop("_h"))
    return engineer(_raw(grid, requests, obs, nwp, stations), targets=False)


def fresh(df: DataFrame) -> DataFrame:
    """Rows whose current observation is at most six hours old at issue."""
    at = F.col("lag_0.matched_at")
    age = F.unix_micros("t0") - F.unix_micros(at)
    return df.filter(at.isNotNull() & (age <= ANCHOR_MAX_AGE_H * 3_600_000_000))


def _ceiling(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(NO_CEILING_FT)))


def state_exprs() -> list[Column]:
    """Features of the observations known at issue."""
    now = F.col("lag_0")
    number = lambda s, f: s[f].cast("double")
    spread = lambda s: number(s, "temp_c") - number(s, "dewpoint_c")
    out = [
        number(now, "vis_m").alias("f_o0_vis"),
        _ceiling(now["ceiling_ft"]).alias("f_o0_ceiling"),
        now["ceiling_ft"].isNotNull().cast("int").alias("f_o0_has_ceiling"),
        number(now, "wind_spd_kt").alias("f_o0_wspd"),
        spread(now).alias("f_o0_spread"),
        number(now, "temp_c").alias("f_o0_temp"),
        *sin_cos_known("f_o0_wdir", now["wind_dir_deg"]),
    ]
    for lag in LAGS_H:
        past = F.col(f"lag_{lag}")
        out += [
            number(past, "vis_m").alias(f"f_o{lag}_vis"),
            _ceiling(past["ceiling_ft"]).alias(f"f_o{lag}_ceiling"),
            spread(past).alias(f"f_o{lag}_spread"),
            (number(now, "vis_m") - number(past, "vis_m")).alias(f"f_dvis_{lag}"),
            (_ceiling(now["ceiling_ft"]) - _ceiling(past["ceiling_ft"])).alias(f"f_dceil_{lag}"),
            (spread(now) - spread(past)).alias(f"f_dspread_{lag}"),
            (number(now, "wind_spd_kt") - number(past, "wind_spd_kt")).alias(f"f_dwspd_{lag}"),
        ]
    return out


def feature_exprs(state: Sequence[str]) -> list[Column]:
    """All features, from the columns ``state`` of the observed ones, the model fields and the grid."""
    dry = lambda s: s["t2m_c"] - s["d2m_c"]
    then, issue = F.col("et"), F.col("e0")
    return [
        *state,
        then["wind10m_spd"].alias("f_et_wspd"), then["gust"].alias("f_et_gust"),
        then["t2m_c"].alias("f_et_t2m"), dry(then).alias("f_et_spread"),
        then["tcc"].alias("f_et_tcc"), then["cbh_m"].alias("f_et_cbh"),
        then["tp_mm"].alias("f_et_tp"), then["mslp_hpa"].alias("f_et_msl"),
        *sin_cos_known("f_et_wdir", then["wind10m_dir"]),
        (then["t2m_c"] - issue["t2m_c"]).alias("f_tend_t2m"),
        (dry(then) - dry(issue)).alias("f_tend_spread"),
        (then["tcc"] - issue["tcc"]).alias("f_tend_tcc"),
        (then["mslp_hpa"] - issue["mslp_hpa"]).alias("f_tend_msl"),
        (then["wind10m_spd"] - issue["wind10m_spd"]).alias("f_tend_wspd"),
        F.col("lead_h").alias("f_lead_h"),
        *day_cycle("f_", F.col("valid_time")),
        F.col("elevation_m").alias("f_elevation"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"),
    ]


def target_exprs() -> list[Column]:
    y = F.col("_y")
    return [
        y["vis_m"].alias("y_vis_m"),
        _ceiling(y["ceiling_ft"]).alias("y_ceiling_ft"),
        y["ceiling_ft"].isNotNull().cast("int").alias("y_has_ceiling"),
        y["wspd"].alias("y_wspd"),
        y["cat"].alias("y_cat"),
        *sin_cos_known("y_wdir", y["wdir"]),
    ]


def engineer(raw: DataFrame, targets: bool) -> DataFrame:
    keys = [c for c in ("obs_id", "icao", "region", "t0", "valid_time", "lead_h") if c in raw.columns]
    state = [c for c in raw.columns if c.startswith("f_")]
    return raw.select(*keys, "o0_time", *feature_exprs(state), *(target_exprs() if targets else []))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("f_")]


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("y_")]


def leakage(samples: DataFrame) -> DataFrame:
    """Rows whose anchor is after issue or whose validity is not. Empty if causal."""
    return samples.filter((F.col("o0_time") > F.col("t0")) | (F.col("t0") >= F.col("valid_time")))


def grid_size(obs: DataFrame, leads: Sequence[int] = LEADS_H, start=None, end=None, icaos=None,
              sample_pct: int | None = None, percent: Column | None = None) -> DataFrame:
    """Number of sample rows a build would have before the freshness filter."""
    percent = hash_percent(F.col("observed_at")) if percent is None else percent
    rows = keep_percent(station_filter(time_window(obs, "observed_at", start, end), icaos),
                        percent, sample_pct)
    return rows.agg((F.count(F.lit(1)) * len(leads)).alias("grid_rows"))
