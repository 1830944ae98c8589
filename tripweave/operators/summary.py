"""Summaries of classified points.

Each function takes the classified points, or :func:`trip_grain` of them. The grain has one
row per trip, country and mode and keeps what every summary needs, so once stored the points
need not be read again. Distinct trips are counted by grouping on the trip first: nothing is
expanded, and a trip that holds a large part of all points shrinks before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .joins import join_lookup
from .percentiles import exact_percentiles

GRAIN_KEYS = [
    "uid", "tid", "transportation_mode", "country_name",
    "trip_avg_speed", "trip_max_speed", "trip_median_speed",
]


def trip_grain(points: DataFrame) -> DataFrame:
    """One row per trip, country and mode with the parts of the measures over its points."""
    if "points" in points.columns:
        return points
    return points.groupBy(*GRAIN_KEYS).agg(
        F.count(F.lit(1)).alias("points"),
        F.count("speed").alias("speed_count"),
        F.sum("speed").alias("speed_sum"),
        F.max("speed").alias("speed_max"),
    )


def trip_id(uid: str = "uid", tid: str = "tid") -> Column:
    """The composed trip id; NULL if a part is. Keys that hold a dash can share an id."""
    return F.concat(F.col(uid), F.lit("-"), F.col(tid))


def trip_keys(composed: Column) -> tuple[Column, Column]:
    """User and trip key of a composed id from outside; right only if the user key has no dash."""
    parts = F.split(composed, "-", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def facet_filter(
    df: DataFrame,
    users: Sequence[str] | None = None,
    modes: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Keep rows that match every facet given; an empty facet does not restrict."""
    chosen = {"uid": users, "transportation_mode": modes, "country_name": countries}
    for column, values in chosen.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def facet_values(points: DataFrame, column: str) -> DataFrame:
    """The values a facet can take. Users keep a NULL, modes and countries do not."""
    values = trip_grain(points).select(column).distinct()
    if column != "uid":
        values = values.filter(F.col(column).isNotNull())
    return values.orderBy(F.col(column).asc_nulls_last())


def overview(points: DataFrame) -> DataFrame:
    """Points, users, trips, average and maximum speed of everything."""
    per_trip = trip_grain(points).groupBy("uid", trip_id().alias("trip_id")).agg(
        F.sum("points").alias("points"),
        F.sum("speed_count").alias("speed_count"),
        F.sum("speed_sum").alias("speed_sum"),
        F.max("speed_max").alias("speed_max"),
    )
    return per_trip.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_points"),
        F.count_distinct("uid").alias("total_users"),
        F.count_distinct("trip_id").alias("total_trips"),
        round_half_up(F.sum("speed_sum") / _positive(F.sum("speed_count"))).alias("avg_speed"),
        round_half_up(F.max("speed_max")).alias("max_speed"),
    )


def _positive(count: Column) -> Column:
    return F.when(count > 0, count)


def _weighted(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips, points and the mean trip speed over points for each value of ``keys``.

    Trip speeds have two digits, so sums as decimals are exact and the same in any order.
    """
    weight = F.when(F.col("trip_avg_speed").isNotNull(), F.col("points"))
    total = F.col("trip_avg_speed").cast("decimal(18,2)") * weight.cast("decimal(18,0)")
    per_trip = trip_grain(points).groupBy(*keys, trip_id().alias("trip_id")).agg(
        F.sum("points").alias("points"),
        F.sum(weight).alias("weight"),
        F.sum(total.cast("decimal(28,2)")).alias("total"),
    )
    mean = F.sum("total").cast("decimal(36,2)") / _positive(F.sum("weight"))
    return per_trip.groupBy(*keys).agg(
        F.count("trip_id").alias("trip_count"),
        F.sum("points").alias("point_count"),
        F.round(mean, 2).cast("double").alias("avg_speed"),
    )


def mode_distribution(points: DataFrame) -> DataFrame:
    """Trips per mode, and the average trip speed weighted by points."""
    known = trip_grain(points).filter(F.col("transportation_mode").isNotNull())
    return (
        _weighted(known, ["transportation_mode"])
        .select("transportation_mode", "trip_count", "avg_speed")
        .orderBy(F.col("trip_count").desc_nulls_first(), "transportation_mode")
    )


def top_countries(points: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` countries with the most trips. A trip counts in every country it touches."""
    known = trip_grain(points).filter(F.col("country_name").isNotNull())
    return (
        _weighted(known, ["country_name"])
        .select("country_name", "trip_count", "point_count")
        .orderBy(F.col("trip_count").desc_nulls_first(), "country_name")
        .limit(n)
    )


def _known_pairs(points: DataFrame) -> DataFrame:
    return trip_grain(points).filter(
        F.col("country_name").isNotNull() & F.col("transportation_mode").isNotNull()
    )


def _pair_counts(points: DataFrame) -> DataFrame:
    return _weighted(_known_pairs(points), ["country_name", "transportation_mode"]).select(
        "country_name", "transportation_mode", "trip_count"
    )


def _by_country(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(
        F.col("country_name").asc_nulls_last(),
        F.col("trip_count").desc_nulls_first(),
        "transportation_mode",
    )


def mode_by_country(points: DataFrame) -> DataFrame:
    """Trips per country and mode."""
    return _by_country(_pair_counts(points))


def mode_by_top_countries(points: DataFrame, n: int = 5) -> DataFrame:
    """:func:`mode_by_country` of the ``n`` countries with the largest total."""
    pairs = _pair_counts(points)
    largest = (
        pairs.groupBy("country_name")
        .agg(F.sum("trip_count").alias("total"))
        .orderBy(F.col("total").desc_nulls_first(), "country_name")
        .limit(n)
        .select("country_name")
    )
    # At most n rows.
    return _by_country(pairs.join(F.broadcast(largest), "country_name", "left_semi"))


def speed_by_mode_country(points: DataFrame, min_trips: int = 5, n: int = 20) -> DataFrame:
    """The ``n`` fastest pairs of country and mode that have at least ``min_trips`` trips."""
    return (
        _weighted(_known_pairs(points), ["country_name", "transportation_mode"])
        .filter(F.col("trip_count") >= min_trips)
        .select("country_name", "transportation_mode", "avg_speed", "trip_count")
        .orderBy(
            F.col("avg_speed").desc_nulls_first(),
            F.col("country_name").asc_nulls_last(),
            "transportation_mode",
        )
        .limit(n)
    )


SPREAD = {"p25_speed": 0.25, "median_speed": 0.5, "p75_speed": 0.75}


def speed_distribution(points: DataFrame) -> DataFrame:
    """Extremes and quartiles of the average speed of trips, per mode."""
    trips = (
        trip_grain(points)
        .filter(F.col("transportation_mode").isNotNull())
        .select("uid", "tid", "transportation_mode", "trip_avg_speed")
        .distinct()
    )
    extremes = trips.groupBy("transportation_mode").agg(
        F.min("trip_avg_speed").alias("min_speed"), F.max("trip_avg_speed").alias("max_speed")
    )
    # Trip speeds are rounded, so a mode has few distinct values however many trips it has.
    quartiles = exact_percentiles(trips, ["transportation_mode"], "trip_avg_speed", SPREAD)
    measures = ["min_speed", *SPREAD, "max_speed"]
    return (
        extremes.join(quartiles, "transportation_mode", "left")
        .withColumns({m: round_half_up(F.col(m)) for m in measures})
        .select("transportation_mode", *measures)
        .orderBy(F.col("median_speed").asc_nulls_last(), "transportation_mode")
    )


def sample_trips(points: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` fastest trips; those without statistics come first."""
    last = ["uid", "tid", "transportation_mode", "country_name"]
    return (
        trip_grain(points)
        .select(
            "uid", "tid", "transportation_mode", "country_name", "points",
            "trip_avg_speed", "trip_max_speed", "trip_median_speed",
        )
        .orderBy(
            F.col("trip_avg_speed").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in last]
        )
        .limit(n)
    )


def trip_list(points: DataFrame) -> DataFrame:
    """Classified trips with their composed id, number of points and average speed."""
    keys = ["uid", "tid", "transportation_mode", "country_name", "trip_avg_speed"]
    return (
        trip_grain(points)
        .filter(F.col("transportation_mode").isNotNull())
        .groupBy(*keys)
        .agg(F.sum("points").alias("points"))
        .select(
            trip_id().alias("trip_id"), "uid", "tid", "transportation_mode", "country_name",
            "points", round_half_up(F.col("trip_avg_speed")).alias("avg_speed"),
        )
        .orderBy(*[F.col(c).asc_nulls_last() for c in keys[:4]])
    )


def trips_for(trips: DataFrame, country: str | None = None, mode: str | None = None) -> DataFrame:
    """The trips of one country and one mode, with how many were found.

    Without a choice every pair of country and mode is kept, each with its own count.
    """
    trips = trips.filter(F.col("country_name").isNotNull())
    if country is not None:
        trips = trips.filter(F.col("country_name") == country)
    if mode is not None:
        trips = trips.filter(F.col("transportation_mode") == mode)
    pair = ["country_name", "transportation_mode"]
    found = trips.groupBy(*pair).agg(F.count(F.lit(1)).alias("trips_found"))
    return join_lookup(trips, found, pair, "inner")
