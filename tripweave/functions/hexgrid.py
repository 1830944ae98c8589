"""A hexagonal grid in axial coordinates ``q`` and ``r``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(q: Column, r: Column) -> Column:
    return F.concat(F.lit("h_"), q.cast("string"), F.lit("_"), r.cast("string"))


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Number of steps between two cells."""
    dq, dr = q2 - q1, r2 - r1
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")
