"""Per-hour scores and skill ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fcverify.functions.conditions import category_rank, is_adverse
from fcverify.schema import TEMPO_PROBABILITY


def outcome(forecast_event: Column, observed_event: Column) -> Column:
    return (
        F.when(forecast_event & observed_event, "hit")
        .when(observed_event, "miss")
        .when(forecast_event, "false_alarm")
        .otherwise("correct_neg")
    )


def angular_difference(a: Column, b: Column) -> Column:
    turn = F.abs(a - b) % F.lit(360)
    return F.when(turn <= 180, turn).otherwise(F.lit(360) - turn)


def adverse_probability(prevailing: Column, tempo: Column, prob: Column) -> Column:
    """Probability of the adverse event that a set of forecast states stands for."""
    from_tempo = F.when(is_adverse(tempo["flight_category"]), F.lit(TEMPO_PROBABILITY)).otherwise(0.0)
    stated = prob["probability"]
    from_prob = F.when(
        is_adverse(prob["flight_category"]),
        F.when(stated > 0, stated / F.lit(100.0)).otherwise(F.lit(TEMPO_PROBABILITY)),
    ).otherwise(0.0)
    return F.when(is_adverse(prevailing["flight_category"]), F.lit(1.0)).otherwise(
        F.greatest(from_tempo, from_prob)
    )


def warned(prevailing: Column, tempo: Column, prob: Column) -> Column:
    """True when any of the states mentions the adverse event."""
    return (
        is_adverse(prevailing["flight_category"])
        | is_adverse(tempo["flight_category"])
        | is_adverse(prob["flight_category"])
    )


def weighted_score(prevailing: Column, tempo: Column, prob: Column, observed: Column) -> Column:
    """3 for the right prevailing category, less for near misses and overlays."""
    distance = F.abs(category_rank(prevailing["flight_category"]) - category_rank(observed))
    near = F.when(distance == 1, F.lit(1.0)).otherwise(0.0)
    by_tempo = F.when(tempo["flight_category"] == observed, F.lit(2.0)).otherwise(0.0)
    by_prob = F.when(
        prob["flight_category"] == observed,
        F.when(F.coalesce(prob["probability"], F.lit(0)) < 40, F.lit(1.0)).otherwise(F.lit(1.5)),
    ).otherwise(0.0)
    return (
        F.when(category_rank(observed).isNull(), F.lit(0.0))
        .when(prevailing["flight_category"] == observed, F.lit(3.0))
        .otherwise(F.greatest(near, by_tempo, by_prob))
    )


def outcome_counts(column: str = "category_outcome") -> list[Column]:
    """The four cells of the contingency table as mergeable aggregates."""
    value = F.col(column)
    return [
        F.count_if(value.isin("hit", "miss", "false_alarm", "correct_neg")).alias("n"),
        F.count_if(value == "hit").alias("hits"),
        F.count_if(value == "miss").alias("misses"),
        F.count_if(value == "false_alarm").alias("false_alarms"),
        F.count_if(value == "correct_neg").alias("correct_neg"),
    ]


def heidke(h: Column, m: Column, f: Column, c: Column) -> Column:
    """Heidke skill score, NULL when chance agreement already explains everything."""
    h, m, f, c = (x.cast("double") for x in (h, m, f, c))
    n = h + m + f + c
    chance = F.try_divide((h + m) * (h + f) + (c + m) * (c + f), n)
    return F.try_divide(h + c - chance, n - chance)


def skill_ratios() -> dict[str, Column]:
    """POD, FAR, CSI, bias and HSS over the columns of ``outcome_counts``."""
    h, m, f, c = (F.col(x) for x in ("hits", "misses", "false_alarms", "correct_neg"))
    return {
        "POD": F.try_divide(h.cast("double"), h + m),
        "FAR": F.try_divide(f.cast("double"), h + f),
        "CSI": F.try_divide(h.cast("double"), h + m + f),
        "bias": F.try_divide((h + f).cast("double"), h + m),
        "HSS": heidke(h, m, f, c),
    }


def brier(p: Column, event: Column) -> Column:
    """Aggregate: mean squared error over rows where both sides are known."""
    miss = p - event.cast("double")
    return F.avg(miss * miss)


def brier_skill(p: Column, event: Column, reference: Column | None = None) -> Column:
    """Aggregate: 1 - BS / BS_ref.

    Without a reference the base rate r of all known events is used, whose score
    is r - r^2, so that everything comes out of one pass of partial sums.
    """
    e = event.cast("double")
    if reference is None:
        rate = F.avg(e)
        bs_ref = rate - rate * rate
    else:
        bs_ref = brier(reference, event)
    return F.when(bs_ref > 0, 1.0 - brier(p, event) / bs_ref)
