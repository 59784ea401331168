"""Absolute times from day-of-month and hour tokens, hour grids and lead times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n)


def hour_floor(time: Column) -> Column:
    return F.date_trunc("hour", time)


def resolve_time(reference: Column, day: Column, hour: Column, minute: Column | None = None) -> Column:
    """The time with this day of month and hour that lies nearest to ``reference``.

    The month before, the month itself and the month after are tried; a month
    without that day is skipped, hour 24 runs into the next day, and the earlier
    candidate wins a tie.
    """
    minute = F.lit(0) if minute is None else F.coalesce(minute, F.lit(0))
    midnight = F.lit(0).cast("decimal(8,6)")

    def candidate(offset):
        month = F.add_months(F.trunc(reference, "month"), offset)
        start = F.try_make_timestamp(F.year(month), F.month(month), day, F.lit(0), F.lit(0), midnight)
        return start + F.make_dt_interval(F.lit(0), hour, minute)

    candidates = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), candidate)
    ranked = F.transform(
        F.filter(candidates, lambda t: t.isNotNull()),
        lambda t, k: F.struct(F.abs(F.unix_micros(t) - F.unix_micros(reference)).alias("gap"),
                              k.alias("k"), t.alias("t")))
    return F.array_min(ranked)["t"]


def lead_hours(valid: Column, issued: Column) -> Column:
    """Whole hours from issue to validity, rounded down also below zero."""
    return F.floor((F.unix_micros(valid) - F.unix_micros(issued)) / F.lit(3_600_000_000)).cast("int")


def hour_boundaries(start: Column, end: Column) -> Column:
    """Number of hour marks crossed between two times."""
    return (
        (F.unix_seconds(hour_floor(end)) - F.unix_seconds(hour_floor(start))) / F.lit(3600)
    ).cast("int")


def lead_bucket(lead: Column, width: int = 6) -> Column:
    return (F.floor(lead / F.lit(width)) * width).cast("int")


def validity_hours(valid_from: Column, valid_to: Column) -> Column:
    """Array of whole hours from the floor of the start up to, not at, the end.

    NULL when there is no such hour; explode then yields no row.
    """
    first = hour_floor(valid_from)
    last = valid_to - F.expr("interval 1 microsecond")
    return F.when(first < valid_to, F.sequence(first, last, F.expr("interval 1 hour")))
