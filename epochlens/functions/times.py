"""Time expressions. The session zone is UTC, so a zone-less timestamp means UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_utc(ts: Column) -> Column:
    """Zone-less values are taken as UTC, zoned ones are instants already."""
    return ts.cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def separation(earlier: Column, later: Column) -> Column:
    """Seconds (2 dp), hours (2 dp) and days (4 dp), never below zero."""
    gap = F.greatest(F.lit(0.0), seconds_between(earlier, later))
    return F.struct(
        F.round(gap, 2).alias("seconds"),
        F.round(gap / 3600.0, 2).alias("hours"),
        F.round(gap / 86400.0, 4).alias("days"),
    )
