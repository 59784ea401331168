"""Column expressions that turn message tokens into canonical conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fcverify.schema import (
    ADVERSE, CATEGORIES, CEILING_BANDS_FT, CEILING_COVERS, ELEMENTS, KMH_PER_KT,
    M_PER_STATUTE_MILE, MPS_TO_KT, VISIBILITY_BANDS_M,
)


def visibility_m(token: Column) -> Column:
    """Visibility token to metres; 9999 and above mean 10 km or more."""
    text = F.upper(F.trim(F.regexp_replace(token, r"^\s*>*<*", "")))
    value = F.trim(F.regexp_replace(text, "SM$", "")).try_cast("double")
    return (
        F.when(text.endswith("SM"), value * M_PER_STATUTE_MILE)
        .when(value >= 9999, F.lit(10000.0))
        .otherwise(value)
    )


def knots(value: Column, unit: Column) -> Column:
    number = value.try_cast("double")
    unit = F.upper(unit)
    return (
        F.when(unit.isin("MPS", "M/S"), number * MPS_TO_KT)
        .when(unit.isin("KMH", "KPH"), number / KMH_PER_KT)
        .otherwise(number)
    )


def wind_direction(token: Column) -> Column:
    """Degrees, NULL for a variable direction."""
    return token.try_cast("int")


def band(value: Column, bands: dict[str, float]) -> Column:
    """Name of the first band (worst first) whose bound lies above ``value``."""
    chain = None
    for name in CATEGORIES:
        if name in bands:
            hit = value < F.lit(bands[name])
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.when(value.isNotNull(), chain.otherwise(CATEGORIES[-1]))


def category_rank(category: Column) -> Column:
    """0 for the worst category up to 3 for the best, NULL when unknown."""
    chain = F.when(category == CATEGORIES[0], F.lit(0))
    for rank, name in enumerate(CATEGORIES[1:], start=1):
        chain = chain.when(category == name, F.lit(rank))
    return chain


def category_of_rank(rank: Column) -> Column:
    chain = F.when(rank == 0, CATEGORIES[0])
    for number, name in enumerate(CATEGORIES[1:], start=1):
        chain = chain.when(rank == number, name)
    return chain


def worse_category(left: Column, right: Column) -> Column:
    """The more restrictive of two categories; an unknown side does not count."""
    chain = F.when((left == CATEGORIES[0]) | (right == CATEGORIES[0]), CATEGORIES[0])
    for name in CATEGORIES[1:]:
        chain = chain.when((left == name) | (right == name), name)
    return chain


def flight_category(ceiling_ft: Column, vis_m: Column,
                    ceiling_bands: dict[str, float] = CEILING_BANDS_FT,
                    vis_bands: dict[str, float] = VISIBILITY_BANDS_M) -> Column:
    """Worse of the ceiling and visibility bands, NULL when both are unknown.

    Written as one chain over the two inputs, so that nesting it in larger
    expressions does not multiply them.
    """
    chain = F.when(ceiling_ft.isNull() & vis_m.isNull(), F.lit(None).cast("string"))
    for name in CATEGORIES[:-1]:
        chain = chain.when((ceiling_ft < ceiling_bands[name]) | (vis_m < vis_bands[name]), name)
    return chain.otherwise(CATEGORIES[-1])


def is_adverse(category: Column) -> Column:
    return F.coalesce(category.isin(*ADVERSE), F.lit(False))


def cloud_layers(tokens: Column) -> Column:
    """Array of layer tokens such as BKN012CB to array<struct<cover,base_ft,cb>>."""
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_extract(t, "^([A-Z]{3})", 1).alias("cover"),
            (F.regexp_extract(t, r"^[A-Z]{3}(\d{3})", 1).try_cast("int") * 100).alias("base_ft"),
            t.endswith("CB").alias("cb"),
        ),
    )


def ceiling(layers: Column, vertical_visibility_ft: Column | None = None) -> Column:
    """Lowest broken or overcast base, or the vertical visibility if that is lower."""
    bases = F.filter(
        F.transform(layers, lambda c: F.when(c["cover"].isin(*CEILING_COVERS), c["base_ft"])),
        lambda base: base.isNotNull(),
    )
    lowest = F.array_min(bases)
    if vertical_visibility_ft is None:
        return lowest
    return F.least(lowest, vertical_visibility_ft.cast("int"))


def weather_token(intensity: Column, descriptor: Column, phenomena: Column) -> Column:
    """Intensity word, descriptor and phenomena back to one token such as -SHRA."""
    prefix = (
        F.when(intensity == "LIGHT", "-")
        .when(intensity == "HEAVY", "+")
        .when(intensity == "IN_VICINITY", "VC")
        .otherwise("")
    )
    return F.concat(prefix, F.coalesce(descriptor, F.lit("")), F.coalesce(phenomena, F.lit("")))


def state(source=None, **overrides) -> Column:
    """State struct with double elements from columns, a struct column or overrides."""

    def element(name):
        if name in overrides:
            return overrides[name]
        return F.col(name) if source is None else source[name]

    return F.struct(
        *[element(e).cast("double").alias(e) for e in ELEMENTS],
        element("flight_category").cast("string").alias("flight_category"),
    )


def sin_cos_known(name: str, degrees: Column) -> list[Column]:
    """Unit-circle encoding of a direction with a flag telling unknown from north."""
    angle = F.radians(degrees.cast("double"))
    return [
        F.coalesce(F.sin(angle), F.lit(0.0)).alias(f"{name}_sin"),
        F.coalesce(F.cos(angle), F.lit(0.0)).alias(f"{name}_cos"),
        degrees.isNotNull().cast("int").alias(f"{name}_known"),
    ]


def day_cycle(prefix: str, time: Column) -> list[Column]:
    """Hour of day and day of year on the unit circle."""
    hour = F.hour(time) * (2 * math.pi) / 24
    day = F.dayofyear(time) * (2 * math.pi) / 365
    return [
        F.sin(hour).alias(f"{prefix}hod_sin"), F.cos(hour).alias(f"{prefix}hod_cos"),
        F.sin(day).alias(f"{prefix}doy_sin"), F.cos(day).alias(f"{prefix}doy_cos"),
    ]


def direction_from_components(sine: Column, cosine: Column) -> Column:
    """Degrees in [0, 360) from sine and cosine, NULL when either is unknown."""
    turned = F.degrees(F.atan2(sine, cosine))
    return F.when(sine.isNotNull() & cosine.isNotNull(), F.pmod(turned, F.lit(360.0)))
