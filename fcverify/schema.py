"""Table schemas and domain constants shared by every module.

The values in this file are fixed by the domain (category bands, tolerances,
lead hours, split dates) and have to be the same wherever scores are compared.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Flight categories from worst to best; the index is the rank.
CATEGORIES = ("LIFR", "IFR", "MVFR", "VFR")
ADVERSE = ("LIFR", "IFR")

# Strict upper bounds: a value below the bound falls in that category.
CEILING_BANDS_FT = {"LIFR": 500, "IFR": 1000, "MVFR": 3000}
VISIBILITY_BANDS_M = {"LIFR": 1600, "IFR": 4800, "MVFR": 8000}
CEILING_COVERS = ("BKN", "OVC", "OVX")

TEMPO_PROBABILITY = 0.4
ALIGN_TOLERANCE_S = 40 * 60
SEQUENCE_TOLERANCE_S = 30 * 60

LEADS_H = (1, 2, 3, 6, 9, 12, 18, 24, 30)
LAGS_H = (1, 3, 6)
ANCHOR_MAX_AGE_H = 6
NO_CEILING_FT = 30000
PAST_LEN = 12
HORIZON = 30
QUANTILES = (0.1, 0.5, 0.9)

# The adverse probabilities a forecast message can express.
PROB_BUCKETS = (0.0, 0.30, 0.40, 1.0)
# (visibility m, ceiling ft) standing for an adverse category.
ADVERSE_FILL = {"IFR": (2500.0, 600.0), "LIFR": (700.0, 200.0)}

TRAIN_END = "2024-01-01"
VALIDATION_END = "2025-01-01"
GATE_START = "2025-01-01"
GATE_END = "2026-01-01"

OFFICIAL_PROFILE = "categorical"
BASELINE_PROFILES = ("persistence", "climatology")

MPS_TO_KT = 1.94384
KMH_PER_KT = 1.852
M_PER_STATUTE_MILE = 1609.34
HPA_PER_INHG = 33.8639

# Elements of a forecast or observed state, all doubles so that observed,
# expanded, climatological and predicted states share one struct type.
ELEMENTS = ("wind_dir_deg", "wind_spd_kt", "wind_gust_kt", "vis_m", "ceiling_ft")

STATE = T.StructType(
    [T.StructField(e, T.DoubleType()) for e in ELEMENTS]
    + [T.StructField("flight_category", T.StringType())]
)
PROB_STATE = T.StructType(STATE.fields + [T.StructField("probability", T.IntegerType())])

CLOUD = T.StructType([
    T.StructField("cover", T.StringType()),
    T.StructField("base_ft", T.IntegerType()),
    T.StructField("cb", T.BooleanType()),
])

STATIONS = T.StructType([
    T.StructField("icao", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("elevation_m", T.IntegerType()),
    T.StructField("region", T.StringType()),
])

RAW_METAR = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("icao", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

RAW_TAF = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("icao", T.StringType()),
    T.StructField("issued_at", T.TimestampType()),
    T.StructField("valid_from", T.TimestampType()),
    T.StructField("valid_to", T.TimestampType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

NWP_FIELDS = ("wind10m_spd", "wind10m_dir", "gust", "t2m_c", "d2m_c", "tcc", "lcc",
              "mcc", "hcc", "cbh_m", "tp_mm", "mslp_hpa")

NWP_POINT = T.StructType([
    T.StructField("icao", T.StringType()),
    T.StructField("valid_time", T.TimestampType()),
    T.StructField("source", T.StringType()),
    *[T.StructField(f, T.DoubleType()) for f in NWP_FIELDS],
])

VERIFICATION_COLUMNS = (
    "taf_id", "icao", "valid_hour", "lead_time_h", "scoring_profile", "fcst_category",
    "obs_category", "category_outcome", "fcst_prob", "wind_err_kt", "dir_err_deg",
    "temp_err_c", "vis_err_m", "ceiling_err_ft", "weighted_score",
)

# Natural keys of the append-only tables.
TABLE_KEYS = {
    "raw_metar": ("icao", "observed_at", "source"),
    "raw_taf": ("icao", "issued_at", "source"),
    "metar_obs": ("raw_metar_id",),
    "taf_forecast": ("raw_taf_id",),
    "nwp_point": ("icao", "valid_time", "source"),
    "verification_hourly": ("taf_id", "valid_hour", "scoring_profile"),
    "expected_hour": ("taf_id", "valid_hour"),
    "taf_group": ("taf_id", "group_seq"),
    "closed_hour": ("icao", "valid_hour"),
}

# The time whose day a table is kept by. It follows from the table's key.
TABLE_TIMES = {
    "raw_metar": "observed_at", "raw_taf": "issued_at", "metar_obs": "observed_at", "taf_forecast": "issued_at",
    "nwp_point": "valid_time", "verification_hourly": "valid_hour", "expected_hour": "valid_hour",
    "taf_group": "valid_from", "closed_hour": "valid_hour",
}
