"""Truck parkings and retail stores from open map data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import path_str, tag_list
from ..functions.rules import RETAIL_CATEGORIES, canonical_brand
from .spatial_join import join_intersects, join_polygons

# Tag key and tag values that mark a parking for trucks.
TRUCK_TAG = "hgv"
TRUCK_TAG_VALUES = ["yes", "designated"]


def explode_tags(df: DataFrame, tags: str = "source_tags") -> DataFrame:
    """One row per tag with ``tag_key`` and ``tag_value``; rows without tags disappear."""
    tag = F.explode(tag_list(F.col(tags))).alias("_tag")
    keep = [c for c in df.columns if c != tags]
    return df.select(*keep, tag).select(
        *keep, F.col("_tag.key").alias("tag_key"), F.col("_tag.value").alias("tag_value")
    )


def hgv_parkings(
    infrastructure: DataFrame,
    countries: DataFrame,
    grid: DataFrame | None = None,
) -> DataFrame:
    """Truck parking areas, one row per parking, country it meets and matching tag."""
    areas = infrastructure.filter(
        F.col("class").ilike("parking%")
        & F.col("subtype").ilike("transit")
        & F.col("geom_type").ilike("polygon")
    )
    # Matching tags are found before the spatial join, which then sees each parking once.
    matching = F.filter(
        tag_list(F.col("source_tags")),
        lambda t: (t["key"] == TRUCK_TAG) & t["value"].isin(TRUCK_TAG_VALUES),
    )
    trucks = (
        areas.select("id", "geometry", matching.alias("_tags")).filter(F.size("_tags") > 0)
    )
    joined = join_polygons(
        trucks, countries.select("id", "geometry", "english_name"), right_grid=grid,
    )
    return joined.withColumn("_tag", F.explode("_tags")).select("id", "english_name", "geometry")


def retail_stores(
    places: DataFrame,
    countries: DataFrame,
    country_name: str = "Germany",
    grid: DataFrame | None = None,
) -> DataFrame:
    """Stores of known brands in the named country."""
    stores = places.withColumns({
        "store_name": path_str(F.col("names"), "$.primary"),
        "category": path_str(F.col("categories"), "$.primary"),
    })
    stores = stores.withColumn("canonical_name", canonical_brand(F.col("store_name"))).filter(
        F.col("canonical_name").isNotNull() & F.col("category").isin(RETAIL_CATEGORIES)
    )
    area = countries.filter(F.col("english_name") == country_name).select("id", "geometry")
    found = join_intersects(stores, area, "inner", grid=grid)
    return found.select(
        "id", "store_name", "category", "lng", "lat", "addresses", "canonical_name"
    )
