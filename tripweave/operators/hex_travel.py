"""Hexagonal neighbourhoods and travel times within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import hex_distance, hex_id
from ..functions.numbers import round_half_even
from ..functions.rules import time_band
from .joins import BROADCAST_BYTES, join_lookup

RINGS = 10


def _check(k: int) -> None:
    if k < 0:
        raise ValueError("number of rings must be 0 or more")


def hex_disk(cells: DataFrame, k: int = RINGS) -> DataFrame:
    """All cells within ``k`` rings of each cell, with their ring; no shuffle."""
    _check(k)
    dq, dr = F.col("_dq"), F.col("_dr")
    return (
        cells.select(F.col("hex_id"), F.col("q"), F.col("r"))
        .withColumn("_dq", F.explode(F.sequence(F.lit(-k), F.lit(k))))
        .withColumn(
            "_dr",
            F.explode(F.sequence(F.greatest(F.lit(-k), -dq - k), F.least(F.lit(k), -dq + k))),
        )
        .select(
            "hex_id",
            hex_id(F.col("q") + dq, F.col("r") + dr).alias("neighbor_hex"),
            hex_distance(F.lit(0), F.lit(0), dq, dr).alias("ring_number"),
        )
    )


def travel_times(
    matrix: DataFrame,
    hexagons: DataFrame,
    k: int = RINGS,
    origin: str | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Travel times from every origin (or one) to the cells within ``k`` rings, with colours.

    The ring is computed from the two cells, so no list of neighbours is built. The origin
    itself is added as a row of zero time, next to one the matrix may already hold. Pairs with
    a cell that is not in ``hexagons`` drop out.
    """
    _check(k)
    if origin is not None:
        matrix = matrix.filter(F.col("origin_hex") == origin)

    def cells(end: str) -> DataFrame:
        return hexagons.select(
            F.col("hex_id").alias(f"{end}_hex"),
            F.struct("q", "r", "latitude", "longitude").alias(f"_{end}"),
        )

    pairs = join_lookup(matrix, cells("dest"), ["dest_hex"], "inner", limit=limit)
    pairs = join_lookup(pairs, cells("origin"), ["origin_hex"], "inner", limit=limit,
                        salt_by=["dest_hex"])
    ring = hex_distance(
        F.col("_origin.q"), F.col("_origin.r"), F.col("_dest.q"), F.col("_dest.r")
    )
    places = [
        F.col(f"_{end}.{long}").alias(f"{end}_{short}")
        for end in ("origin", "dest")
        for long, short in (("latitude", "lat"), ("longitude", "lon"))
    ]
    near = pairs.withColumn("ring", ring).filter(F.col("ring") <= k).select(
        "origin_hex", "dest_hex", "distance_km", "duration_minutes", *places, "ring"
    )
    own = hexagons if origin is None else hexagons.filter(F.col("hex_id") == origin)
    own = own.select(
        F.col("hex_id").alias("origin_hex"), F.col("hex_id").alias("dest_hex"),
        F.lit(0e0).alias("distance_km"), F.lit(0e0).alias("duration_minutes"),
        F.col("latitude").alias("origin_lat"), F.col("longitude").alias("origin_lon"),
        F.col("latitude").alias("dest_lat"), F.col("longitude").alias("dest_lon"),
        F.lit(0).alias("ring"),
    )
    return near.unionByName(own).withColumn("color", time_band(F.col("duration_minutes")))


def neighbour_detail(times: DataFrame) -> DataFrame:
    """Neighbours of each origin by ring, then time."""
    return _neighbours(times).select(
        "origin_hex", "dest_hex", "ring", "duration_minutes", "distance_km", "dest_lat", "dest_lon"
    ).orderBy("origin_hex", "ring", F.col("duration_minutes").asc_nulls_last(), "dest_hex")


def _neighbours(times: DataFrame) -> DataFrame:
    return times.filter(F.col("dest_hex") != F.col("origin_hex"))


def neighbour_summary(times: DataFrame) -> DataFrame:
    """Number of neighbours, mean and longest time, mean distance for each origin.

    All rows but the one added for the origin count as neighbours; the measures leave out every
    row of the origin to itself.
    """
    away = F.col("dest_hex") != F.col("origin_hex")
    time, km = F.when(away, F.col("duration_minutes")), F.when(away, F.col("distance_km"))
    return times.groupBy("origin_hex").agg(
        (F.count(F.lit(1)) - 1).alias("neighbours"),
        round_half_even(F.avg(time), 1).alias("avg_time"),
        round_half_even(F.max(time), 1).alias("max_time"),
        round_half_even(F.avg(km), 1).alias("avg_distance"),
    )


def ring_stats(times: DataFrame) -> DataFrame:
    """Times and mean distance for each origin and ring; cells without a time do not count."""
    return _neighbours(times).groupBy("origin_hex", "ring").agg(
        round_half_even(F.min("duration_minutes"), 1).alias("min_time"),
        round_half_even(F.avg("duration_minutes"), 1).alias("avg_time"),
        round_half_even(F.max("duration_minutes"), 1).alias("max_time"),
        F.count("duration_minutes").alias("hexagons"),
        round_half_even(F.avg("distance_km"), 1).alias("avg_distance"),
    )
