"""Unit conversions of gridded model fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fcverify.schema import MPS_TO_KT


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_from_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees in [0, 360); calm counts as 180."""
    return F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_knots(mps: Column) -> Column:
    return mps * MPS_TO_KT


def to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def to_mm(metres: Column) -> Column:
    return metres * 1000.0


def to_hpa(pascal: Column) -> Column:
    return pascal / 100.0
