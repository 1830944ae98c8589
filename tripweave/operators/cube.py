"""Overview measures by facet, from mergeable exact sets.

The cube has a row per user, mode and country and per group of 64 numbers of trips, with the set of
the trips in it as a bitmap of one word, and the sums behind the averages. Bitmaps of any selection
are merged by OR and counted, so distinct trips of a filtered overview come from one scan of the
cube, without expanding rows for distinct aggregates. Users are counted through the number that
stands for each of them, in bitmaps of the same kind. Numbers follow the order of the values, so the
trips of a user share a word or a few; the cube never has more sets than there are rows of the grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .summary import _positive, trip_grain, trip_id

FACETS = ["uid", "transportation_mode", "country_name"]
#: Numbers to a bitmap, the bits of a long: sets of few members stay small, and aggregates hash them.
WORD = 64


def numbered(grain: DataFrame, column: Column, name: str, stage) -> DataFrame:
    """(value, name): a number for each distinct value, in order and in runs without gaps.

    ``stage`` stores a DataFrame under a name and reads it back: a number must never change.
    """
    values = grain.select(column.alias("_value")).where("_value IS NOT NULL").distinct()
    values = values.repartitionByRange("_value").sortWithinPartitions("_value")
    return stage(values.withColumn(name, F.monotonically_increasing_id()), f"numbers_{name}")


def facet_cube(points: DataFrame, stage) -> DataFrame:
    """The cube of classified points or their :func:`trip_grain`.

    Columns: the facets, ``kind`` ('trip', 'user' or 'sums'), ``bucket`` and ``bitmap`` of the
    sets, and the sums of points and speeds, which stand in the rows of kind 'sums'.
    """
    grain = trip_grain(points).withColumn("_trip", trip_id())
    trips = numbered(grain, F.col("_trip"), "trip_number", stage)
    users = numbered(grain, F.col("uid"), "user_number", stage)
    rows = grain.join(trips.withColumnRenamed("_value", "_trip"), "_trip", "left")

    def sets(rows: DataFrame, number: str, kind: str) -> DataFrame:
        return rows.where(f"{number} IS NOT NULL").groupBy(
            *FACETS, F.lit(kind).alias("kind"), F.expr(f"{number} div {WORD}").alias("bucket")
        ).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({number} % {WORD} AS int))")).alias("bitmap"))

    sums = grain.groupBy(*FACETS).agg(
        F.sum("points").alias("points"), F.sum("speed_count").alias("speed_count"),
        F.sum("speed_sum").alias("speed_sum"), F.max("speed_max").alias("speed_max"),
        F.sum(F.when(F.col("trip_avg_speed").isNotNull(), F.col("points"))).alias("weight"),
        F.sum(
            F.col("trip_avg_speed").cast("decimal(18,2)") * F.col("points").cast("decimal(18,0)")
        ).cast("decimal(36,2)").alias("total"),
    ).withColumn("kind", F.lit("sums"))
    # One user, one bit: the set of users needs no more than their facets.
    by_user = sums.select(*FACETS).join(users.withColumnRenamed("_value", "uid"), "uid", "left")
    return (
        sets(rows, "trip_number", "trip")
        .unionByName(sets(by_user, "user_number", "user"))
        .unionByName(sums, allowMissingColumns=True)
    )


def _merged(cube: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: distinct ``trips`` and ``users``, and the sums."""
    of = cube.groupBy(*keys, "kind", "bucket").agg(
        F.bit_count(F.bit_or("bitmap")).alias("n"),
        F.sum("points").alias("points"), F.sum("speed_count").alias("speed_count"),
        F.sum("speed_sum").alias("speed_sum"), F.max("speed_max").alias("speed_max"),
        F.sum("weight").alias("weight"), F.sum("total").alias("total"),
    )

    def counted(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    mean = F.sum("total").cast("decimal(36,2)") / _positive(F.sum("weight"))
    return of.groupBy(*keys).agg(
        counted("trip").alias("trip_count"), counted("user").alias("user_count"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("point_count"),
        round_half_up(F.sum("speed_sum") / _positive(F.sum("speed_count"))).alias("mean_speed"),
        round_half_up(F.max("speed_max")).alias("max_speed"),
        F.round(mean, 2).cast("double").alias("avg_speed"),
    )


def overview(cube: DataFrame) -> DataFrame:
    """As :func:`tripweave.operators.summary.overview`, of a cube that any facet may restrict."""
    return _merged(cube, []).select(
        F.col("point_count").alias("total_points"), F.col("user_count").alias("total_users"),
        F.col("trip_count").alias("total_trips"), F.col("mean_speed").alias("avg_speed"), "max_speed",
    )


def mode_distribution(cube: DataFrame) -> DataFrame:
    known = cube.filter(F.col("transportation_mode").isNotNull())
    return _merged(known, ["transportation_mode"]).select(
        "transportation_mode", "trip_count", "avg_speed"
    ).orderBy(F.col("trip_count").desc_nulls_first(), "transportation_mode")


def top_countries(cube: DataFrame, n: int = 10) -> DataFrame:
    known = cube.filter(F.col("country_name").isNotNull())
    return _merged(known, ["country_name"]).select("country_name", "trip_count", "point_count").orderBy(
        F.col("trip_count").desc_nulls_first(), "country_name"
    ).limit(n)


def _pairs(cube: DataFrame) -> DataFrame:
    pair = ["country_name", "transportation_mode"]
    return _merged(cube.dropna(subset=pair), pair)


def mode_by_country(cube: DataFrame) -> DataFrame:
    return _pairs(cube).select("country_name", "transportation_mode", "trip_count").orderBy(
        "country_name", F.col("trip_count").desc_nulls_first(), "transportation_mode"
    )


def speed_by_mode_country(cube: DataFrame, min_trips: int = 5, n: int = 20) -> DataFrame:
    return (
        _pairs(cube).filter(F.col("trip_count") >= min_trips)
        .select("country_name", "transportation_mode", "avg_speed", "trip_count")
        .orderBy(F.col("avg_speed").desc_nulls_first(), "country_name", "transportation_mode").limit(n)
    )
