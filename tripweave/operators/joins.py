"""Joins that hold when one key owns a large part of all rows.

Two tools. :func:`join_lookup` broadcasts a side whose size was measured to be small; otherwise
it finds the hot keys by a sketch and spreads these, and only these, with a salt. Trips that hold
too many points are cut by time in :mod:`tripweave.operators.trajectory`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 128 * 1024 * 1024
SALTS = 32
#: A key is hot if it has more than one row in so many; a sketch of this many counters names it.
HOT_SHARE = 1000
_COUNTERS = 16 * HOT_SHARE


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Estimated size of one value; arrays and text count by their length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ArrayType):
            nested = F.transform(value, lambda v: _bytes_of(v, inner).cast("long"))
            total = F.aggregate(nested, F.lit(0).cast("long"), lambda acc, n: acc + n)
            return F.coalesce(total, F.lit(0)) + 16
        width = 8 * len(inner.fields) + 24 if isinstance(inner, T.StructType) else 16
        return F.greatest(F.size(value), F.lit(0)) * width + 24
    if isinstance(kind, T.StructType):
        parts = [_bytes_of(value[f.name], f.dataType) for f in kind.fields]
        return sum(parts, F.lit(16))
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 16
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` in memory, estimated by one aggregation over it on the executors."""
    row = sum((_bytes_of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("n")).first()["n"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def row_salt(df: DataFrame) -> list[str]:
    """The columns whose hash tells the rows of a hot key apart: all of atomic type."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def hot_keys(df: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> list[int]:
    """Hashes of the keys that more than one row in ``share`` has: at most ``share`` of them.

    One pass over the keys with a frequent-items sketch, merged from all tasks. It misses no such
    key; one that is a little less frequent may be named, too, which costs copies but no row.
    """
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)).select(F.xxhash64(*on).alias("h"))
    top = F.expr(f"approx_top_k(h, {share}, {_COUNTERS})")
    row = known.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    # An estimate can be too high by the rows over the counters.
    return [t["item"] for t in row["top"] or [] if t["count"] * share > row["n"]]


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    condition: Column | None = None,
    salt_by: Sequence[str] | None = None,
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
    small: bool | None = None,
) -> DataFrame:
    """Join the large ``left`` to a ``right`` that is usually small, on equal key columns.

    ``right`` is broadcast when its measured size is within ``limit`` bytes, or as ``small`` says.
    Beyond that both sides shuffle by key and salt. Only hot keys of ``left`` have salts, made
    from ``salt_by`` (all atomic columns unless named), and only their rows of ``right`` are
    copied once per salt, so a key that owns a third of ``left`` is spread over ``salts``
    partitions and ``right`` does not grow; so are rows of ``left`` with a NULL key, which match
    nothing. ``condition`` is an extra predicate over columns of both sides that takes part in
    the match, so a left join keeps rows it rejects.

    The result has the columns of ``left``, then those of ``right`` without the keys.
    """
    keyed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on]
    )
    match = None
    for k in on:
        equal = F.col(k) == F.col(f"_r_{k}")
        match = equal if match is None else match & equal
    if condition is not None:
        match = match & condition
    extra = [c for c in right.columns if c not in on] if how in ("left", "inner") else []
    if fits_broadcast(right, limit) if small is None else small:
        joined = left.join(F.broadcast(keyed), match, how)
    else:
        hot = hot_keys(left, on)
        names = salt_by or row_salt(left)
        salt = F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")
        none = F.lit(False)
        for k in on:
            none = none | F.col(k).isNull()
        is_hot = F.xxhash64(*on).isin(hot) if hot else F.lit(False)
        salted = left.withColumn("_l_salt", F.when(none | is_hot, salt).otherwise(F.lit(0)))
        is_hot = F.xxhash64(*[f"_r_{k}" for k in on]).isin(hot) if hot else F.lit(False)
        own = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        copies = keyed.withColumn("_r_salt", F.explode(own))
        joined = salted.join(copies, match & (F.col("_l_salt") == F.col("_r_salt")), how)
    return joined.select(*left.columns, *extra)
