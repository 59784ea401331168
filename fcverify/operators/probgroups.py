"""Forecast groups from calibrated probabilities and predicted elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.conditions import direction_from_components, flight_category, is_adverse, worse_category
from fcverify.schema import ADVERSE_FILL, PROB_BUCKETS, PROB_STATE, STATE


def nearest_bucket(p: Column) -> Column:
    """Index of the expressible probability nearest to ``p``, the lower one on a tie."""
    gaps = [F.abs(p - F.lit(b)) for b in PROB_BUCKETS]
    chain = None
    for i, gap in enumerate(gaps[:-1]):
        closest = gap <= F.least(*gaps[i + 1:]) if len(gaps) - i > 2 else gap <= gaps[-1]
        chain = F.when(closest, F.lit(i)) if chain is None else chain.when(closest, F.lit(i))
    return F.when(p.isNotNull(), chain.otherwise(F.lit(len(gaps) - 1)))


def quantised(p: Column) -> dict[str, Column]:
    """commit, group_type and group_probability a probability is expressed by."""
    bucket = nearest_bucket(p)
    return {
        "commit": bucket == 3,
        "group_type": F.when(bucket == 1, "PROB30").when(bucket == 2, "PROB40"),
        "group_probability": F.when(bucket == 1, PROB_BUCKETS[1]).when(bucket == 2, PROB_BUCKETS[2])
        .when(bucket == 3, PROB_BUCKETS[3]).otherwise(PROB_BUCKETS[0]),
    }


def element_state(vector: Column) -> Column:
    """State struct from predicted vis, ceiling, wspd, wdir_sin and wdir_cos."""
    vis = F.greatest(F.lit(0.0), vector["vis"])
    sine, cosine = vector["wdir_sin"], vector["wdir_cos"]
    known = F.abs(sine) + F.abs(cosine) > 1e-6
    return F.struct(
        F.when(known, direction_from_components(sine, cosine)).alias("wind_dir_deg"),
        F.greatest(F.lit(0.0), vector["wspd"]).alias("wind_spd_kt"),
        F.lit(None).cast("double").alias("wind_gust_kt"),
        vis.alias("vis_m"), vector["ceiling"].alias("ceiling_ft"),
        flight_category(vector["ceiling"], vis).alias("flight_category"))


def forced_adverse(state: Column) -> Column:
    """The state with an adverse category and elements no better than it stands for."""
    category = F.when(is_adverse(state["flight_category"]), state["flight_category"]).otherwise("IFR")
    worst = state["flight_category"] == "LIFR"
    cap = lambda i: F.when(worst, ADVERSE_FILL["LIFR"][i]).otherwise(ADVERSE_FILL["IFR"][i])
    return F.struct(
        state["wind_dir_deg"].alias("wind_dir_deg"), state["wind_spd_kt"].alias("wind_spd_kt"),
        state["wind_gust_kt"].alias("wind_gust_kt"), F.least(state["vis_m"], cap(0)).alias("vis_m"),
        F.least(state["ceiling_ft"], cap(1)).alias("ceiling_ft"), category.alias("flight_category"))


def hours_from_quantiles(df: DataFrame, p: str = "p_adverse", low: str = "q10", median: str = "q50") -> DataFrame:
    """Expected hours from quantile structs and the adverse probability.

    A committed hour states the adverse low-quantile conditions; otherwise the
    median prevails, with the low-quantile conditions as a PROB group if the
    probability is worth one.
    """
    staged = df.withColumns({
        **{f"_{k}": c for k, c in quantised(F.col(p)).items()},
        "_bad": element_state(F.col(low)), "_mid": element_state(F.col(median))})
    staged = staged.withColumn("_bad", forced_adverse(F.col("_bad")))
    percent = F.round(F.col("_group_probability") * 100).cast("int")
    overlay = F.struct(*[F.col("_bad")[f.name].alias(f.name) for f in STATE.fields], percent.alias("probability"))
    return staged.withColumns({
        "prevailing": F.when(F.col("_commit"), F.col("_bad")).otherwise(F.col("_mid")),
        "tempo": F.lit(None).cast(STATE),
        "prob": F.when(F.col("_group_type").isNotNull(), overlay).cast(PROB_STATE),
        "group_type": F.col("_group_type"),
    }).drop("_commit", "_group_type", "_group_probability", "_bad", "_mid")


def expand_horizons(issues: DataFrame, quantiles: str = "quantiles", p: str = "p_adverse") -> DataFrame:
    """Issues with arrays over the horizon to one row per hour: valid = t0 + lead.

    ``quantiles`` is an array of structs q10, q50; step k is lead k + 1.
    """
    zipped = F.arrays_zip(F.col(quantiles).alias("q"), F.col(p).alias("p"))
    keep = [c for c in issues.columns if c not in (quantiles, p)]
    rows = issues.select(*keep, F.posexplode(zipped).alias("_k", "_s"))
    lead = (F.col("_k") + 1).alias("lead_h")
    return rows.select(*keep, lead, (F.col("t0") + F.make_dt_interval(F.lit(0), F.col("_k") + 1)).alias("valid_hour"),
                       F.col("_s.q.q10").alias("q10"), F.col("_s.q.q50").alias("q50"), F.col("_s.p").alias("p_adverse"))


def hours_from_predictions(df: DataFrame, adverse: str = "adverse") -> DataFrame:
    """Expected hours from a model's element predictions and its adverse decision.

    The decision rules the category: at least IFR when it says adverse, at best
    MVFR turned from IFR or worse when it does not.
    """
    vis = F.greatest(F.lit(0.0), F.col("pred_vis_m"))
    ceiling = F.when(F.col("pred_has_ceiling") >= 0.5, F.col("pred_ceiling_ft"))
    staged = df.withColumns({"_vis": vis, "_ceil": ceiling})
    derived = flight_category(F.col("_ceil"), F.col("_vis"))
    staged = staged.withColumn("_derived", derived)
    category = F.when(F.col(adverse), worse_category(F.col("_derived"), F.lit("IFR"))).otherwise(
        F.when(is_adverse(F.col("_derived")), "MVFR").otherwise(F.col("_derived")))
    prevailing = F.struct(
        direction_from_components(F.col("pred_wdir_sin"), F.col("pred_wdir_cos")).alias("wind_dir_deg"),
        F.greatest(F.lit(0.0), F.col("pred_wspd")).alias("wind_spd_kt"),
        F.lit(None).cast("double").alias("wind_gust_kt"), F.col("_vis").alias("vis_m"),
        F.col("_ceil").cast("double").alias("ceiling_ft"), category.alias("flight_category"))
    return staged.withColumns({"prevailing": prevailing, "tempo": F.lit(None).cast(STATE),
                               "prob": F.lit(None).cast(PROB_STATE)}).drop("_vis", "_ceil", "_derived")
