"""Segments between consecutive points of a trip, and what they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import mean_speed, minutes, round_half_up, segment_km
from ..functions.rules import speed_band
from .trajectory import (
    SLICE,
    TRIP,
    HotTrips,
    edge_rows,
    find_hot_trips,
    neighbour_columns,
    over_border,
    restore_keys,
    slice_window,
    trip_window,
    with_slice_key,
)

# A point within two areas is two rows of the same time, told apart by the country.
TIE = ("event_id", "country_code")
_FIELDS = ["lat", "lng", "speed", "time_lag"]


def _keyed_segments(points: DataFrame, tie: Sequence[str], hot: HotTrips) -> DataFrame:
    """Each point but a trip's last with its successor's fields as ``_n_<field>``.

    Partitioned by slice key; ``_row`` numbers the points of a slice.
    """
    keyed = with_slice_key(points, hot, tie).select(
        *SLICE, "_hot", "event_timestamp", *tie, *[c for c in _FIELDS if c not in tie]
    )
    near = neighbour_columns(keyed, F.lead, tie, _FIELDS).withColumn(
        "_row", F.row_number().over(slice_window(tie))
    )
    if hot.any:
        near = over_border(near, edge_rows(keyed, "first", tie, _FIELDS), F.lead, _FIELDS)
    return near.filter(F.col("_n_row").isNotNull()).withColumns({
        "_speed": mean_speed(F.col("speed"), F.col("_n_speed")),
        "_km": segment_km(F.col("speed"), F.col("_n_speed"), F.col("_n_time_lag")),
    })


def _slice_sums() -> dict[str, Column]:
    """Number, length and time of the segments of a slice; the time of the first point apart."""
    return {
        "_segments": F.count(F.lit(1)),
        "_kms": F.sum("_km"),
        "_lag": F.sum("_n_time_lag"),
        "_first_lag": F.min_by("time_lag", "_row"),
    }


def trip_segments(
    points: DataFrame, tie: Sequence[str] = TIE, hot: HotTrips | None = None
) -> DataFrame:
    """One row per pair of consecutive points, with the totals of the trip on each.

    Distance is the sum of mean speed times time over the segments. Row numbers start at 1.
    """
    hot = hot or find_hot_trips(points, tie=tie)
    segments = _keyed_segments(points, tie, hot)
    # A trip in one piece has its totals in its own partition.
    here = Window.partitionBy(*SLICE)
    sums = _slice_sums()
    out = segments.withColumns({n: sums[n].over(here) for n in ("_kms", "_lag", "_first_lag")})
    number, km = F.col("_row"), F.col("_kms")
    seconds = _plus(F.col("_lag"), F.col("_first_lag"))
    if hot.any:
        # Totals of hot trips, and the segments before each slice, from one row per slice.
        per_slice = segments.filter("_hot").groupBy(*SLICE).agg(
            *[c.alias(n) for n, c in sums.items()]
        )
        whole = Window.partitionBy(*TRIP)
        upward = trip_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = per_slice.select(
            *SLICE,
            (F.sum("_segments").over(upward) - F.col("_segments")).alias("_before"),
            F.sum("_kms").over(whole).alias("_trip_km"),
            _plus(F.sum("_lag").over(whole), F.first("_first_lag").over(upward)).alias("_trip_lag"),
        )
        out = out.join(totals, list(SLICE), "left")
        number = number + F.coalesce("_before", F.lit(0))
        km = F.when(F.col("_hot"), F.col("_trip_km")).otherwise(km)
        seconds = F.when(F.col("_hot"), F.col("_trip_lag")).otherwise(seconds)
    out = out.withColumns({
        "rn": number.cast("long"),
        "lat1": F.col("lat"), "lon1": F.col("lng"),
        "lat2": F.col("_n_lat"), "lon2": F.col("_n_lng"),
        "segment_duration_seconds": F.col("_n_time_lag"),
        "avg_speed": round_half_up(F.col("_speed")),
        "color": speed_band(F.col("_speed")),
        "total_duration_seconds": seconds,
        "total_distance_km": round_half_up(km),
        "segment_geojson": geo.geojson(
            "LineString",
            geo.line(F.col("lng"), F.col("lat"), F.col("_n_lng"), F.col("_n_lat")),
        ),
    })
    return restore_keys(out, [
        "uid", "tid", "rn", "lat1", "lon1", "lat2", "lon2", "segment_geojson", "avg_speed",
        "segment_duration_seconds", "color", "total_duration_seconds", "total_distance_km",
    ])


def _plus(total: Column, more: Column) -> Column:
    """Sum that skips NULL, as the aggregate does."""
    return F.when(total.isNotNull() | more.isNotNull(),
                  F.coalesce(total, F.lit(0)) + F.coalesce(more, F.lit(0)))


def trip_endpoints(segments: DataFrame) -> DataFrame:
    """First and last position of each trip, from its segments."""
    return segments.groupBy("uid", "tid").agg(
        F.min_by("lat1", "rn").alias("start_lat"), F.min_by("lon1", "rn").alias("start_lon"),
        F.max_by("lat2", "rn").alias("end_lat"), F.max_by("lon2", "rn").alias("end_lon"),
    )


def trip_metrics(
    points: DataFrame, tie: Sequence[str] = TIE, hot: HotTrips | None = None
) -> DataFrame:
    """Ends, duration, distance and number of segments of each trip with two points or more."""
    segments = _keyed_segments(points, tie, hot or find_hot_trips(points, tie=tie))
    # First to slices, in place, then to trips: no task holds all segments of a long trip.
    per_slice = segments.groupBy(*SLICE).agg(
        F.min_by("lat", "_row").alias("start_lat"), F.min_by("lng", "_row").alias("start_lon"),
        F.max_by("_n_lat", "_row").alias("end_lat"), F.max_by("_n_lng", "_row").alias("end_lon"),
        *[c.alias(n) for n, c in _slice_sums().items()],
    )
    seconds = _plus(F.sum("_lag"), F.min_by("_first_lag", "_slice"))
    out = per_slice.groupBy(*TRIP).agg(
        F.min_by("start_lat", "_slice").alias("start_lat"),
        F.min_by("start_lon", "_slice").alias("start_lon"),
        F.max_by("end_lat", "_slice").alias("end_lat"),
        F.max_by("end_lon", "_slice").alias("end_lon"),
        F.sum("_segments").alias("segments"),
        round_half_up(F.sum("_kms")).alias("total_distance_km"),
        seconds.alias("total_duration_seconds"),
    ).withColumn("total_duration_minutes", minutes(F.col("total_duration_seconds")))
    return restore_keys(out, [
        "uid", "tid", "start_lat", "start_lon", "end_lat", "end_lon", "segments",
        "total_duration_seconds", "total_duration_minutes", "total_distance_km",
    ])


# Zoom step for a largest span in degrees below the bound, and beyond.
ZOOM_STEPS = [(0.01, 14), (0.05, 12), (0.1, 11), (0.5, 10), (1.0, 9), (2.0, 8)]
WIDEST_ZOOM = 7
PADDING_SHARE = 0.15
LEAST_PADDING = 0.01


def trip_extent(trips: DataFrame) -> DataFrame:
    """Bounds, padding, centre and zoom of the area between the two ends of each trip."""
    out = trips.select("uid", "tid", "start_lat", "start_lon", "end_lat", "end_lon")
    for axis in ("lat", "lon"):
        ends = [F.col(f"start_{axis}"), F.col(f"end_{axis}")]
        span = F.col(f"max_{axis}") - F.col(f"min_{axis}")
        share = span * F.lit(PADDING_SHARE)
        out = out.withColumns({
            f"min_{axis}": F.least(*ends), f"max_{axis}": F.greatest(*ends)
        }).withColumns({
            f"{axis}_padding": F.when(share == 0, F.lit(LEAST_PADDING)).otherwise(share),
            f"center_{axis}": (F.col(f"min_{axis}") + F.col(f"max_{axis}")) / F.lit(2e0),
        })
    widest = F.greatest(*[
        F.col(f"max_{a}") - F.col(f"min_{a}") + F.col(f"{a}_padding") for a in ("lat", "lon")
    ])
    zoom = F
    for bound, step in ZOOM_STEPS:
        zoom = zoom.when(widest < bound, step)
    return out.withColumn("zoom_level", zoom.otherwise(WIDEST_ZOOM)).drop(
        "start_lat", "start_lon", "end_lat", "end_lon"
    )
