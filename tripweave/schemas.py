"""Declared schemas of the input tables, and the check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A polygon is an array of rings, a ring an array of [lng, lat] points. Parts and holes of a
# multi-part polygon are all rings of one array: inside means inside an odd number of rings.
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

COUNTRY_REFERENCE = _struct(iso_code=_S, english_name=_S, official_name=_S)

POINTS = _struct(
    uid=_S, tid=_S, event_id=_L, lat=_D, lng=_D, zero_col=_I, alt=_D, dayno=_D,
    event_date=T.DateType(), event_time=_S, event_timestamp=T.TimestampType(),
)

BBOX = _struct(xmin=_D, xmax=_D, ymin=_D, ymax=_D)

# Nested columns are stored as JSON text and become variants on read.
DIVISIONS = _struct(
    id=_S, country=_S, names=_S, geometry=RINGS, bbox=BBOX, subtype=_S,
    **{"class": _S}, region=_S,
)

INFRASTRUCTURE = _struct(
    id=_S, **{"class": _S}, subtype=_S, geom_type=_S, geometry=RINGS, source_tags=_S,
)

PLACES = _struct(id=_S, lng=_D, lat=_D, names=_S, categories=_S, addresses=_S)

HEXAGONS = _struct(hex_id=_S, q=_I, r=_I, latitude=_D, longitude=_D)

TRAVEL_MATRIX = _struct(origin_hex=_S, dest_hex=_S, distance_km=_D, duration_minutes=_D)

ROUTE_RESPONSES = _struct(uid=_S, tid=_S, profile=_S, response=_S)


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` reduced to the columns of ``schema``; an error names what is missing or mistyped."""
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} {f.dataType.simpleString()}"
        for f in schema.fields
        if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError(f"missing or mistyped columns: {', '.join(wrong)}")
    return df.select(*schema.fieldNames())
