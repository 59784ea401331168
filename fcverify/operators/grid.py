"""Gridded model fields to station series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import nwp as N
from fcverify.operators.barrier import once
from fcverify.schema import NWP_FIELDS


def merge_streams(first: DataFrame, second: DataFrame,
                  keys: Sequence[str] = ("time", "latitude", "longitude")) -> DataFrame:
    """One grid from two that share coordinates; the first wins where both have a field."""
    shared = [c for c in first.columns if c in second.columns and c not in keys]
    a = first.select(*keys, *[F.col(c).alias(f"_a_{c}") if c in shared else F.col(c)
                              for c in first.columns if c not in keys])
    b = second.select(*keys, *[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c)
                               for c in second.columns if c not in keys])
    joined = a.join(b, list(keys), "full")
    fields = [c for c in first.columns if c not in keys] + [
        c for c in second.columns if c not in keys and c not in shared]
    return joined.select(*keys, *[
        F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) if c in shared else F.col(c) for c in fields])


def point_records(points: DataFrame, source: str = "era5") -> DataFrame:
    """Station series in display units. Absent variables and NaN become NULL."""
    columns = set(points.columns)

    def raw(name) -> Column:
        if name not in columns:
            return F.lit(None).cast("double")
        return N.nan_to_null(F.col(name).cast("double"))

    u, v = raw("u10"), raw("v10")
    gust = raw("fg10") if "fg10" in columns else raw("i10fg")
    time = F.col("valid_time" if "valid_time" in columns else "time")
    fields = {
        "wind10m_spd": N.to_knots(N.wind_speed(u, v)),
        "wind10m_dir": N.wind_from_direction(u, v),
        "gust": N.to_knots(gust),
        "t2m_c": N.to_celsius(raw("t2m")),
        "d2m_c": N.to_celsius(raw("d2m")),
        "tcc": raw("tcc"), "lcc": raw("lcc"), "mcc": raw("mcc"), "hcc": raw("hcc"),
        "cbh_m": raw("cbh"),
        "tp_mm": N.to_mm(raw("tp")),
        "mslp_hpa": N.to_hpa(raw("msl")),
    }
    return points.select("icao", time.alias("valid_time"), F.lit(source).alias("source"),
                         *[fields[f].alias(f) for f in NWP_FIELDS])


def _axis(grid: DataFrame, name: str) -> Column:
    """Sorted axis values as a scalar. As long as the axis, whatever the grid's size:
    the set is built from partial sets of the same bound."""
    return grid.agg(F.array_sort(F.collect_set(name)).alias(name)).scalar()


def _nearest_on(axis: Column, at: Column) -> Column:
    """Axis value with the smallest distance, the larger one on a tie."""
    return F.array_min(F.transform(
        axis, lambda a: F.struct(F.abs(a - at).alias("d"), (-a).alias("m"), a.alias("v"))))["v"]


def station_cells(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """(icao, latitude, longitude): nearest grid latitude and longitude, each on its own."""
    placed = stations.select("icao", "lat", "lon", _axis(grid, "latitude").alias("_lats"),
                             _axis(grid, "longitude").alias("_lons"))
    return once(placed.select("icao", _nearest_on(F.col("_lats"), F.col("lat")).alias("latitude"),
                              _nearest_on(F.col("_lons"), F.col("lon")).alias("longitude")))


def extract_points(grid: DataFrame, stations: DataFrame, source: str = "era5") -> DataFrame:
    """Series of the grid cell nearest to every station.

    The station side is joined by equality on the cell, so the grid is scanned
    once and not shuffled while the stations fit the broadcast threshold.
    """
    return point_records(grid.join(station_cells(grid, stations), ["latitude", "longitude"]), source)
