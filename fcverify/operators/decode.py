"""Decoding of raw observation and forecast messages with column expressions.

A message is cleaned to single spaces, cut into segments with one regular
expression split, and every element is read from its segment. Nothing leaves the
JVM and no shuffle is needed; a message that does not decode keeps NULL key times
and is set apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import conditions as C
from fcverify.functions.timetokens import resolve_time
from fcverify.operators.barrier import once
from fcverify.schema import HPA_PER_INHG

# Message grammar, fixed by the code forms.
REPORT_HEAD = r"^(?:METAR |SPECI |TAF )*(?:COR |AMD )?([A-Z][A-Z0-9]{3}) "
ISSUE_TIME = r" (\d{2})(\d{2})(\d{2})Z "
VALIDITY = r" (\d{2})(\d{2})/(\d{2})(\d{2}) "
FROM_TIME = r"^ ?FM(\d{2})(\d{2})(\d{2}) "
WIND = r" (VRB|\d{3})(\d{2,3})(?:G(\d{2,3}))?(KT|MPS|KMH|KPH|KM/H) "
VISIBILITY = r" (?:(\d{4})(?:NDV)?|([MP]?\d+(?:/\d+)?SM)) "
CLOUD_LAYER = r" ((?:FEW|SCT|BKN|OVC|OVX)(?:\d{3}|///)(?:CB|TCU)?)(?= )"
VERTICAL_VISIBILITY = r" VV(\d{3}) "
TEMPERATURES = r" (M?\d{2})/(M?\d{2}) "
PRESSURE_HPA = r" Q(\d{4}) "
PRESSURE_INHG = r" A(\d{4}) "
WEATHER = (r"^(?=.)([-+]|VC)?(MI|BC|PR|DR|BL|SH|TS|FZ)?((?:DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|"
           r"SQ|FC|SS|DS|PY)*)$")
OBSERVATION_TREND = r" (?:NOSIG|BECMG|TEMPO|RMK)(?= ).*$"
CHANGE_START = r" (?=(?:BECMG|PROB\d{2}|FM\d{6}) )|(?<!PROB\d{2}) (?=TEMPO )"
CHANGE_KIND = r"^ ?(?:PROB(\d{2}) )?(TEMPO|BECMG|FM)?"

INTENSITY_WORDS = {"-": "LIGHT", "+": "HEAVY", "VC": "IN_VICINITY"}


def clean(raw: Column) -> Column:
    """Upper-case words separated by single spaces, with a space at both ends."""
    text = F.rtrim(F.upper(raw), F.lit("= \t\r\n"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))


def _part(text: Column, pattern: str, group: int) -> Column:
    """A regular expression group, NULL when it is absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _signed(token: Column) -> Column:
    return F.regexp_replace(token, "^M", "-").try_cast("double")


def weather_tokens(text: Column) -> Column:
    """Weather groups of a segment, rebuilt from intensity, descriptor and phenomena."""
    words = F.filter(F.split(F.trim(text), " "), lambda w: w.rlike(WEATHER))

    def rebuild(word):
        sign = F.regexp_extract(word, WEATHER, 1)
        intensity = None
        for mark, name in INTENSITY_WORDS.items():
            hit = sign == mark
            intensity = F.when(hit, name) if intensity is None else intensity.when(hit, name)
        return C.weather_token(intensity, F.regexp_extract(word, WEATHER, 2), F.regexp_extract(word, WEATHER, 3))

    return F.transform(words, rebuild)


def with_conditions(df: DataFrame, text: str) -> DataFrame:
    """Wind, visibility, clouds, weather and category of the segment column ``text``.

    Tokens are cut first and converted in a second step, so that no regular
    expression runs more than once per row.
    """
    body = F.col(text)
    statute = F.regexp_replace(F.regexp_replace(_part(body, VISIBILITY, 2), "^P", ">"), "^M", "<")
    tokens = {
        "_dir": _part(body, WIND, 1), "_spd": _part(body, WIND, 2), "_gust": _part(body, WIND, 3),
        "_unit": _part(body, WIND, 4),
        "_vis": F.coalesce(_part(body, VISIBILITY, 1), statute),
        "_cavok": body.contains(" CAVOK "),
        "_vv": _part(body, VERTICAL_VISIBILITY, 1),
        "clouds": C.cloud_layers(F.regexp_extract_all(body, F.lit(CLOUD_LAYER), F.lit(1))),
        "weather": weather_tokens(body),
    }
    values = {
        "wind_dir_deg": C.wind_direction(F.col("_dir")),
        "wind_spd_kt": C.knots(F.col("_spd"), F.col("_unit")),
        "wind_gust_kt": C.knots(F.col("_gust"), F.col("_unit")),
        "vis_m": C.visibility_m(F.col("_vis")),
        "ceiling_ft": C.ceiling(F.col("clouds"), F.col("_vv").try_cast("int") * 100),
    }
    clear = F.greatest(F.col("vis_m"), F.when(F.col("_cavok"), F.lit(10000.0)))
    return (
        df.withColumns(tokens).withColumns(values).withColumn("vis_m", clear)
        .withColumn("flight_category", C.flight_category(F.col("ceiling_ft"), F.col("vis_m")))
        .drop("_dir", "_spd", "_gust", "_unit", "_vis", "_cavok", "_vv")
    )


def decode_observations(raw: DataFrame, reference: str = "observed_at", keep: Sequence[str] = ()) -> DataFrame:
    """Raw observations (id, observed_at, raw_text) to decoded rows, with the columns ``keep`` as they are.

    The time tokens are placed next to the reference time; without them the
    reference itself counts. Trend and remark parts are left out of the state.
    """
    text = raw.select("id", *keep, F.col(reference).alias("_ref"), clean(F.col("raw_text")).alias("_text"))
    head = F.ltrim(F.col("_text"))
    day, hour, minute = (_part(F.col("_text"), ISSUE_TIME, i).try_cast("int") for i in (1, 2, 3))
    cut = text.select(
        "id", *keep, "_ref", F.regexp_extract(head, REPORT_HEAD, 1).alias("icao"),
        day.alias("_d"), hour.alias("_h"), minute.alias("_m"),
        F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(head, REPORT_HEAD, ""), OBSERVATION_TREND, " "))
        .alias("_body"))
    rows = with_conditions(once(cut), "_body").withColumns({
        "observed_at": F.when(F.col("_d").isNull(), F.col("_ref")).otherwise(
            resolve_time(F.col("_ref"), F.col("_d"), F.col("_h"), F.col("_m"))),
        "temp_c": _signed(_part(F.col("_body"), TEMPERATURES, 1)),
        "dewpoint_c": _signed(_part(F.col("_body"), TEMPERATURES, 2)),
        "qnh_hpa": F.coalesce(_part(F.col("_body"), PRESSURE_HPA, 1).try_cast("double"),
                              _part(F.col("_body"), PRESSURE_INHG, 1).try_cast("double") / 100 * HPA_PER_INHG),
    })
    return rows.select(
        *keep, F.col("id").alias("obs_id"), F.col("id").alias("raw_metar_id"), "icao", "observed_at", "wind_dir_deg",
        "wind_spd_kt", "wind_gust_kt", "vis_m", "temp_c", "dewpoint_c", "qnh_hpa", "ceiling_ft",
        "flight_category", "clouds", "weather")


def readable_observations(decoded: DataFrame) -> DataFrame:
    """Rows that decoded. The others stay pending in the raw table for a later run."""
    return decoded.filter((F.col("icao") != "") & F.col("observed_at").isNotNull())


def group_type(probability: Column, kind: Column) -> Column:
    """FM, BECMG, TEMPO, PROBnn or PROBnn_TEMPO."""
    return F.when(probability.isNull(), kind).otherwise(
        F.concat(F.lit("PROB"), probability, F.when(kind == "TEMPO", "_TEMPO").otherwise("")))


def split_forecasts(raw: DataFrame) -> DataFrame:
    """Header and text segments of raw forecasts (id, issued_at, raw_text).

    Segment 0 is the base part; each following one is a change group.
    """
    text = raw.select("id", "issued_at", F.split(clean(F.col("raw_text")), CHANGE_START).alias("_seg"))
    text = once(text)
    base = F.concat(F.lit(" "), F.trim(F.col("_seg")[0]), F.lit(" "))
    number = lambda i: _part(base, VALIDITY, i).try_cast("int")
    timed = text.select(
        "id", "issued_at", "_seg", F.regexp_extract(F.ltrim(base), REPORT_HEAD, 1).alias("icao"),
        *[number(i).alias(f"_v{i}") for i in (1, 2, 3, 4)])
    timed = once(timed).withColumn("valid_from", resolve_time(F.col("issued_at"), F.col("_v1"), F.col("_v2")))
    timed = once(timed).withColumn("valid_to", resolve_time(F.col("valid_from"), F.col("_v3"), F.col("_v4")))
    return timed.drop("_v1", "_v2", "_v3", "_v4")


def readable_forecasts(split: DataFrame) -> DataFrame:
    return split.filter((F.col("icao") != "") & F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull())


def forecast_headers(split: DataFrame) -> DataFrame:
    """taf_forecast rows. The raw id is the forecast id, so nothing is read back."""
    return readable_forecasts(split).select(
        F.col("id").alias("taf_id"), F.col("id").alias("raw_taf_id"), "icao", "issued_at", "valid_from", "valid_to")


def forecast_groups(split: DataFrame) -> DataFrame:
    """taf_group rows, numbered by ``group_seq`` in message order.

    FM groups carry a start only and last to the end of the forecast here.
    """
    rows = readable_forecasts(split).select(
        F.col("id").alias("taf_id"), "valid_from", "valid_to",
        F.posexplode("_seg").alias("group_seq", "_raw"))
    text = F.concat(F.lit(" "), F.trim(F.col("_raw")), F.lit(" "))
    rows = rows.withColumn("_text", text)
    number = lambda pattern, i: _part(F.col("_text"), pattern, i).try_cast("int")
    base = F.col("group_seq") == 0
    kind = _part(F.col("_text"), CHANGE_KIND, 2)
    prob = _part(F.col("_text"), CHANGE_KIND, 1)
    rows = rows.withColumns({
        "group_type": F.when(base, "BASE").otherwise(group_type(prob, kind)),
        "probability": F.when(~base, prob.try_cast("int")),
        **{f"_f{i}": number(FROM_TIME, i) for i in (1, 2, 3)},
        **{f"_p{i}": number(VALIDITY, i) for i in (1, 2, 3, 4)},
    })
    is_from = F.col("group_type") == "FM"
    rows = rows.withColumn("_start", F.when(base, F.col("valid_from")).otherwise(resolve_time(
        F.col("valid_from"), F.when(is_from, F.col("_f1")).otherwise(F.col("_p1")),
        F.when(is_from, F.col("_f2")).otherwise(F.col("_p2")), F.when(is_from, F.col("_f3")))))
    rows = rows.withColumn("_end", F.when(base | is_from, F.col("valid_to")).otherwise(
        resolve_time(F.col("_start"), F.col("_p3"), F.col("_p4"))))
    # Header tokens of the base part must not be read as weather.
    body = F.when(base, F.concat(F.lit(" "), F.regexp_replace(F.ltrim("_text"), REPORT_HEAD, ""))).otherwise(
        F.col("_text"))
    return with_conditions(rows.withColumn("_body", body), "_body").select(
        "taf_id", "group_seq", "group_type", "probability", F.col("_start").alias("valid_from"),
        F.col("_end").alias("valid_to"), "wind_dir_deg", "wind_spd_kt", "wind_gust_kt", "vis_m", "ceiling_ft",
        "flight_category", "clouds", "weather")


def encode_nested(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text, for a boundary that has no nested types."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_nested(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """JSON text back to nested columns; text that does not parse becomes NULL and is
    kept beside it in ``<column>_text``."""
    out = df
    for name, ddl in types.items():
        parsed = F.from_json(name, ddl, {"mode": "PERMISSIVE"})
        valid = F.col(name).isNull() | F.get_json_object(name, "$").isNotNull()
        out = out.withColumn(f"{name}_text", F.when(~valid, F.col(name))).withColumn(name, F.when(valid, parsed))
    return out
