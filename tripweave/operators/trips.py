"""Speed statistics of trips and the transport mode they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..functions.rules import classify_mode
from .joins import join_lookup
from .percentiles import ROWS, exact_percentiles
from .trajectory import (
    SLICE,
    TRIP,
    HotTrips,
    attach_to_trips,
    find_hot_trips,
    restore_keys,
    with_slice_key,
    with_trip_key,
)

QUARTILES = {"median_speed": 0.5, "p75_speed": 0.75, "p25_speed": 0.25}
_MOMENTS = ["avg_speed", "max_speed", "min_speed", "stddev_speed"]


def _moments() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("point_count"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.min("speed").alias("min_speed"),
        F.stddev_samp("speed").alias("stddev_speed"),
    ]


def trip_statistics(
    points: DataFrame, hot: HotTrips | None = None, rows: int = ROWS
) -> DataFrame:
    """Count, mean, extremes, spread and quartiles of the valid speeds of each trip, rounded.

    One aggregate with Spark's percentile, which holds the values of a trip together; the
    quartiles of hot trips are found without that, by the same formula, and no task sorts more
    than ``rows`` of their values.
    """
    hot = hot or find_hot_trips(points)
    valid = with_trip_key(points.filter(F.col("speed") >= 0)).select(*TRIP, "speed")
    parts = []
    if hot.any:
        marked = join_lookup(
            valid, hot.trips.select(*TRIP, F.lit(True).alias("_hot")), TRIP, "left",
            salt_by=["speed"],
        )
        large = marked.filter("_hot").drop("_hot")
        quartiles = exact_percentiles(large, TRIP, "speed", QUARTILES, rows)
        parts.append(large.groupBy(*TRIP).agg(*_moments()).join(quartiles, list(TRIP)))
        valid = marked.filter(F.col("_hot").isNull()).drop("_hot")
    # Percentile has little to combine before the shuffle: values go straight to their trip.
    together = valid.repartition(*TRIP).groupBy(*TRIP)
    quantiles = F.percentile("speed", list(QUARTILES.values())).alias("_q")
    stats = together.agg(*_moments(), quantiles).select(
        *TRIP, "point_count", *_MOMENTS, *[F.col("_q")[i].alias(n) for i, n in enumerate(QUARTILES)]
    )
    for part in parts:
        stats = stats.unionByName(part)
    measures = [*_MOMENTS, *QUARTILES]
    stats = stats.withColumns({m: round_half_up(F.col(m)) for m in measures})
    return restore_keys(stats, ["uid", "tid", "point_count", *measures])


def classify_trips(stats: DataFrame) -> DataFrame:
    """:func:`trip_statistics` rows with their transport mode."""
    mode = classify_mode(F.col("avg_speed"), F.col("max_speed"), F.col("median_speed"))
    return stats.select(
        "uid", "tid", "point_count", "avg_speed", "max_speed", "median_speed",
        mode.alias("transportation_mode"),
    )


def trip_modes(points: DataFrame, hot: HotTrips | None = None) -> DataFrame:
    return classify_trips(trip_statistics(points, hot))


def attach_trip_mode(
    points: DataFrame, trips: DataFrame, hot: HotTrips | None = None
) -> DataFrame:
    """Points with the mode and speeds of their trip; NULL where the trip has no valid speed."""
    per_trip = trips.select(
        "uid", "tid", "transportation_mode",
        F.col("avg_speed").alias("trip_avg_speed"),
        F.col("max_speed").alias("trip_max_speed"),
        F.col("median_speed").alias("trip_median_speed"),
    )
    return attach_to_trips(points, per_trip, hot)


LABELS = {"avg_speed": "trip_avg_speed", "max_speed": "trip_max_speed", "median_speed": "trip_median_speed"}


def label_points(
    points: DataFrame, hot: HotTrips | None = None, rows: int = ROWS
) -> DataFrame:
    """Points with the mode and speeds of their trip, as ``attach_trip_mode`` of ``trip_modes``.

    Points move once: they are partitioned by trip, and statistics and labels come from one
    window over that. Hot trips stay cut into slices; their statistics are found apart and come
    back to the slices by a join that moves one row per slice.
    """
    hot = hot or find_hot_trips(points)
    keyed = with_slice_key(points, hot)
    valid = F.when(F.col("speed") >= 0, F.col("speed"))
    trip = Window.partitionBy(*SLICE)
    # A hot trip is not gathered: its values are not looked at here.
    here = F.when(~F.col("_hot"), valid)
    stats = {
        "avg_speed": F.avg(here).over(trip), "max_speed": F.max(here).over(trip),
        "median_speed": F.percentile(here, F.lit(0.5)).over(trip),
    }
    labelled = keyed.withColumns(stats)
    labelled = labelled.withColumns({n: round_half_up(F.col(n)) for n in LABELS})
    if hot.any:
        marked = join_lookup(
            with_trip_key(points), hot.trips.select(*TRIP), TRIP, "left_semi", salt_by=["speed"]
        )
        large = with_trip_key(trip_statistics(marked.select(*points.columns), hot, rows))
        per_trip = large.select(*TRIP, *[F.col(n).alias(f"_{n}") for n in LABELS])
        slices = keyed.filter("_hot").select(*SLICE).distinct()
        per_slice = join_lookup(slices, per_trip, TRIP, "inner", salt_by=["_slice"])
        labelled = labelled.join(per_slice, list(SLICE), "left").withColumns({
            n: F.when(F.col("_hot"), F.col(f"_{n}")).otherwise(F.col(n)) for n in LABELS
        })
    known = F.col("_null") == 0
    mode = classify_mode(F.col("avg_speed"), F.col("max_speed"), F.col("median_speed"))
    # A trip without a valid speed has no label; one that no rule fits is unknown.
    mode = F.when(known & F.col("avg_speed").isNotNull(), mode)
    labelled = labelled.withColumns({
        "transportation_mode": mode, **{new: F.when(known, F.col(n)) for n, new in LABELS.items()},
    })
    return restore_keys(labelled, [*points.columns, "transportation_mode", *LABELS.values()])
