"""Exact interpolated percentiles of groups of any size.

Spark's ``percentile`` keeps all distinct values of a group in one buffer. Here values are counted,
and each wanted rank is narrowed down round after round: the range that holds it is cut into equal
parts, the counts of the parts name the part with the rank, and its least and greatest value are
the next range. A range of few distinct values is sorted, one of a single value is the answer,
however many rows it has. So no task sees more of a group than ``rows`` distinct values, wherever
they lie. The interpolation is the one of ``percentile``, term for term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .joins import join_lookup

#: Parts that a range is cut into in a round, and distinct values that one task may sort.
PARTS = 1024
ROWS = 1_000_000


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], rows: int = ROWS
) -> DataFrame:
    """One row per group with a column per entry of ``probabilities``.

    NULL and NaN values are ignored; ``keys`` must not be NULL. ``rows`` changes the work, not the
    result. Between two ranks the value is interpolated linearly.
    """
    keys = list(keys)
    shared_dir(df.sparkSession)
    given = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    # Read in every round: counted once, kept where all hosts read it.
    counts = given.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    totals = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.count(F.lit(1)).alias("_values"),
    )

    def position(p: float):
        return (F.col("_total") - 1) * F.lit(float(p))

    ends = [e(position(p)).cast("long") for p in probabilities.values() for e in (F.floor, F.ceil)]
    wanted = totals.withColumn("_rank", F.explode(F.array_distinct(F.array(*ends)))).select(
        *keys, "_rank", F.lit(0).cast("long").alias("_before"), "_lo", "_hi", "_values"
    ).checkpoint()
    one = [*keys, "_rank"]
    while not (open_ := wanted.where((F.col("_lo") < F.col("_hi")) & (F.col("_values") > rows))).isEmpty():
        inside = join_lookup(counts, open_.drop("_values"), keys, "inner", salt_by=["_v"])
        inside = inside.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # Halves, so that the width of any two finite values is finite.
        width = (F.col("_hi") / 2 - F.col("_lo") / 2) / PARTS
        part = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / F.when(width > 0, width))
        part = F.least(F.coalesce(part, F.lit(0)), F.lit(PARTS - 1))
        # Between neighbours that no width tells apart, the greatest stands alone.
        part = F.when((width > 0) | (F.col("_v") < F.col("_hi")), part).otherwise(F.lit(PARTS - 1))
        parts = inside.groupBy(*one, "_before", part.alias("_part")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.count(F.lit(1)).alias("_values"),
        )
        upward = Window.partitionBy(*one).orderBy("_part")
        end = F.col("_before") + F.sum("_n").over(upward)
        found = parts.withColumn("_end", end).where("_rank >= _end - _n AND _rank < _end").select(
            *one, (F.col("_end") - F.col("_n")).alias("_before"), "_lo", "_hi", "_values"
        )
        closed = wanted.where((F.col("_lo") == F.col("_hi")) | (F.col("_values") <= rows))
        wanted = closed.unionByName(found).checkpoint()

    single = wanted.where("_lo = _hi").select(*one, F.col("_lo").alias("_v"))
    few = wanted.where("_lo < _hi").drop("_values")
    inside = join_lookup(counts, few, keys, "inner", salt_by=["_v"])
    inside = inside.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*one).orderBy("_v"))
    sorted_ = inside.withColumn("_end", end).where("_rank >= _end - _n AND _rank < _end").select(*one, "_v")
    at = single.unionByName(sorted_).join(totals.select(*keys, "_total"), keys)

    def ranked(end) -> list:
        return [
            F.max(F.when(F.col("_rank") == end(position(p)).cast("long"), F.col("_v"))).alias(f"_{end.__name__}_{n}")
            for n, p in probabilities.items()
        ]

    found = at.groupBy(*keys, "_total").agg(*ranked(F.floor), *ranked(F.ceil))
    out = {}
    for name, p in probabilities.items():
        low, high, pos = F.col(f"_floor_{name}"), F.col(f"_ceil_{name}"), position(p)
        between = (F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high
        out[name] = F.when(low == high, low).otherwise(between)
    return found.withColumns(out).select(*keys, *probabilities)
