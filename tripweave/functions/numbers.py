"""Rounding, time gaps and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3.6e3
KMH_PER_MS = 3.6e0


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round half up on the decimal value, so that binary noise at a tie does not decide."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value.cast("decimal(28,10)"), digits).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    """Number of second boundaries between two timestamps: .9 s to 1.1 s is one."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def kmh(metres: Column, seconds: Column) -> Column:
    """Speed; the caller guards a gap of zero seconds."""
    return metres / seconds * F.lit(KMH_PER_MS)


def segment_km(speed1: Column, speed2: Column, seconds: Column) -> Column:
    """Length of a segment driven at the mean of the speeds (km/h) at its two ends."""
    return mean_speed(speed1, speed2) * (seconds / F.lit(SECONDS_PER_HOUR))


def mean_speed(speed1: Column, speed2: Column) -> Column:
    return (speed1 + speed2) / F.lit(2e0)


def minutes(seconds: Column) -> Column:
    return round_half_even(seconds / F.lit(6e1), 2)


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def as_km(metres: Column) -> Column:
    """Metres, made whole first, as kilometres with two digits."""
    return F.round(_whole(metres).cast("decimal(28,0)") / F.lit(1000), 2).cast("double")


def as_minutes(seconds: Column) -> Column:
    """Seconds, made whole first, as minutes with two digits."""
    return F.round(_whole(seconds).cast("decimal(28,0)") / F.lit(60), 2).cast("double")
