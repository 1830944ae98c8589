"""Readers of the input tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import geo


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return schemas.require_columns(spark.read.parquet(path), schema)


def as_variants(df: DataFrame, *columns: str) -> DataFrame:
    """JSON text columns as variants; text that is not JSON becomes NULL."""
    return df.withColumns({c: F.try_parse_json(F.col(c)) for c in columns})


def _kind(df: DataFrame, column: str) -> str | None:
    found = [f.dataType.simpleString() for f in df.schema.fields if f.name.lower() == column]
    return found[0] if found else None


def _with_text_id(df: DataFrame) -> DataFrame:
    """Ids are text, whether they are stored as text or as numbers."""
    return df.withColumn("id", F.col("id").cast("string")) if _kind(df, "id") == "bigint" else df


def _with_rings(df: DataFrame) -> DataFrame:
    """Stored GeoJSON as rings, its kind in ``geom_type``; rings that are there stay.

    Damaged text and kinds without an area have NULL rings, and so lie nowhere.
    """
    if _kind(df, "geometry") != "string":
        return df
    text = F.col("geometry")
    return df.withColumn("geom_type", geo.geom_type(text)).withColumn("geometry", geo.stored_rings(text))


def _with_place(df: DataFrame) -> DataFrame:
    """Longitude and latitude of a stored GeoJSON point, where the table has no such columns."""
    if _kind(df, "geometry") != "string" or _kind(df, "lng"):
        return df
    lng, lat = geo.stored_point(F.col("geometry"))
    return df.withColumns({"lng": lng, "lat": lat})


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """GPS points. A table without ``event_id`` gets one: a hash of the whole row.

    The hash orders points of the same time for good; equal rows are equal anyway.
    """
    df = spark.read.parquet(path)
    if _kind(df, "event_id") is None:
        df = df.withColumn("event_id", F.xxhash64(*[F.col(c) for c in df.columns]))
    return schemas.require_columns(df, schemas.POINTS)


def read_divisions(spark: SparkSession, path: str) -> DataFrame:
    df = _with_rings(spark.read.parquet(path))
    return as_variants(schemas.require_columns(df, schemas.DIVISIONS), "names")


def read_infrastructure(spark: SparkSession, path: str) -> DataFrame:
    df = _with_text_id(_with_rings(spark.read.parquet(path)))
    return as_variants(schemas.require_columns(df, schemas.INFRASTRUCTURE), "source_tags")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    df = _with_text_id(_with_place(spark.read.parquet(path)))
    columns = ("names", "categories", "addresses")
    return as_variants(schemas.require_columns(df, schemas.PLACES), *columns)


def read_hexagons(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.HEXAGONS)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.TRAVEL_MATRIX)


def read_route_responses(spark: SparkSession, path: str) -> DataFrame:
    return as_variants(_read(spark, path, schemas.ROUTE_RESPONSES), "response")
