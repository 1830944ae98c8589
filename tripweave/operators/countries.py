"""Country areas and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import path_str
from .joins import join_lookup


def build_countries(divisions: DataFrame, reference: DataFrame) -> DataFrame:
    """Land areas of country level with their names; unknown codes get NULL names."""
    areas = divisions.filter((F.col("subtype") == "country") & (F.col("class") == "land"))
    areas = areas.withColumnRenamed("country", "iso_code")
    named = join_lookup(areas, reference, ["iso_code"], "left")
    return named.select(
        "id", "iso_code", "english_name", "official_name",
        path_str(F.col("names"), "$.primary").alias("local_name"),
        "geometry", "bbox", "subtype", "class", "region",
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, and how often; empty if the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; raises if ``keys`` do not identify its rows."""
    found = duplicate_keys(df, keys).take(1)
    if found:
        raise ValueError(f"key {tuple(keys)} is not unique: {found[0].asDict()}")
    return df
