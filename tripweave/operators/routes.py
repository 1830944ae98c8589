"""Planned routes and their comparison with the trips driven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import path_str
from ..functions.numbers import as_km, as_minutes, round_half_up
from ..functions.rules import route_profile


def route_summary(responses: DataFrame) -> DataFrame:
    """Geometry, length and duration of the first route in each stored response."""
    route = "$.features[0]"

    def number(name: str):
        path = f"{route}.properties.summary.{name}"
        return F.try_variant_get(F.col("response"), path, "decimal(38,10)")

    return responses.select(
        "uid", "tid", "profile",
        path_str(F.col("response"), f"{route}.geometry").alias("geometry_geojson"),
        as_km(number("distance")).alias("distance_km"),
        as_minutes(number("duration")).alias("duration_minutes"),
    )


def trip_profiles(trips: DataFrame) -> DataFrame:
    """Trips with the routing profile for their mode."""
    return trips.withColumn("profile", route_profile(F.col("transportation_mode")))


def route_comparison(actual: DataFrame, planned: DataFrame) -> DataFrame:
    """Actual against planned distance and duration by trip and profile; actual minus planned.

    ``actual`` are trip metrics with a ``profile``, ``planned`` is :func:`route_summary`.
    """
    driven = actual.select(
        "uid", "tid", "profile",
        F.col("total_distance_km").alias("actual_distance_km"),
        F.col("total_duration_minutes").alias("actual_duration_minutes"),
    )
    routes = planned.select(
        "uid", "tid", "profile",
        F.col("distance_km").alias("planned_distance_km"),
        F.col("duration_minutes").alias("planned_duration_minutes"),
    )
    return driven.join(routes, ["uid", "tid", "profile"], "inner").withColumns({
        f"{what}_difference": round_half_up(
            F.col(f"actual_{what}_{unit}") - F.col(f"planned_{what}_{unit}")
        )
        for what, unit in (("distance", "km"), ("duration", "minutes"))
    })
