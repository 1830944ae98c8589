"""From raw points and map data to the stored tables the dashboard queries read.

Each step is written under a name of its own: no step replaces its own input, and running the
pipeline again gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.countries import assert_unique, build_countries
from ..operators.pois import hgv_parkings, retail_stores
from ..operators.spatial_join import cover, join_within
from ..operators.summary import trip_grain
from ..operators.trajectory import HotTrips, drop_outlier_trips, find_hot_trips
from ..operators.trips import label_points
from ..sources.stages import write_stage

TRIP_ORDER = ("uid", "tid", "event_timestamp")


@dataclass(frozen=True)
class Inputs:
    points: DataFrame
    divisions: DataFrame
    reference: DataFrame
    infrastructure: DataFrame
    places: DataFrame
    store_country: str = "Germany"
    hot: HotTrips | None = None


def points_country(
    points: DataFrame, countries: DataFrame, grid: DataFrame | None = None
) -> DataFrame:
    """Points with code and name of the country they lie in; one row per country if several."""
    named = countries.selectExpr(
        "id", "geometry", "iso_code AS country_code", "english_name AS country_name"
    )
    return join_within(points, named, "left", grid=grid)


def points_mode(points: DataFrame, hot: HotTrips | None = None) -> DataFrame:
    return label_points(points, hot)


Step = tuple[str, Callable[[Inputs, Callable[[str], DataFrame]], DataFrame], tuple | None]

# Name, how to build it from the inputs and earlier stages, and the columns to cluster by.
STEPS: list[Step] = [
    ("countries", lambda i, s: build_countries(i.divisions, i.reference), None),
    ("country_cover", lambda i, s: cover(s("countries")), None),
    ("points_clean", lambda i, s: drop_outlier_trips(i.points, hot=i.hot), None),
    (
        "points_country",
        lambda i, s: points_country(s("points_clean"), s("countries"), s("country_cover")),
        None,
    ),
    ("points_mode", lambda i, s: points_mode(s("points_country"), i.hot), TRIP_ORDER),
    ("trip_grain", lambda i, s: trip_grain(s("points_mode")), None),
    (
        "hgv_parkings",
        lambda i, s: hgv_parkings(i.infrastructure, s("countries"), grid=s("country_cover")),
        None,
    ),
    (
        "retail_stores",
        lambda i, s: retail_stores(
            i.places, s("countries"), i.store_country, grid=s("country_cover")
        ),
        None,
    ),
]


def run_pipeline(spark: SparkSession, inputs: Inputs, root: str) -> dict[str, DataFrame]:
    """Build and store every stage below ``root``; returns them as read back."""
    assert_unique(inputs.reference, ["iso_code"])
    assert_unique(inputs.divisions, ["id"])
    # Found once on the raw points; all later tables hold parts of the same trips.
    inputs = replace(inputs, hot=inputs.hot or find_hot_trips(inputs.points))
    built: dict[str, DataFrame] = {}
    for name, build, cluster_by in STEPS:
        built[name] = write_stage(build(inputs, built.__getitem__), root, name, cluster_by)
    return built
