"""The input tables, derived row by row from the test tables (see FIXTURES.md).

The test tables hold no GPS or map data. Every input below is a projection of one of them, so
it grows with it and needs no shuffle; route responses and the travel matrix are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hexgrid import hex_distance, hex_id
from ..functions.rules import DEFAULT_PROFILE
from ..operators.hex_travel import hex_disk
from ..operators.joins import join_lookup
from .country_names import COUNTRY_NAMES
from .readers import as_variants

US_PER_WEEK = 604_800_000_000
US_PER_TICK = 600_000_000
TICKS_PER_WEEK = US_PER_WEEK // US_PER_TICK
KM_PER_DEGREE = 111.195e0
# Speed in km/h by user_id % 8.
SPEEDS = [0.2e0, 4e0, 9e0, 18e0, 30e0, 70e0, 120e0, 13e0]

HEX_COLUMNS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _choose(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    base = events.select(
        "event_id", "user_id", "value",
        F.expr(f"unix_micros(cast(ts as timestamp)) div {US_PER_WEEK}").alias("week"),
        F.expr(f"unix_micros(cast(ts as timestamp)) div {US_PER_TICK}").alias("t"),
    )
    user = F.col("user_id")
    km = F.col("sp") * (F.col("t") - F.col("week") * TICKS_PER_WEEK) / F.lit(3.6e3)
    jitter = (
        F.when(F.col("value") > 330, F.lit(5e0))
        .when(user % 8 == 7, F.col("value") / F.lit(1e3))
        .otherwise(F.col("value") / F.lit(1e5))
    )
    at = F.timestamp_seconds(F.col("t"))
    band = F.expr("user_id div 5") % 5
    return base.withColumn("sp", _choose(user % 8, SPEEDS)).select(
        user.cast("string").alias("uid"),
        F.col("week").cast("string").alias("tid"),
        "event_id",
        (F.lit(1e1) * (user % 5) + F.lit(5e0) + (km + jitter) / F.lit(KM_PER_DEGREE)).alias("lat"),
        (
            F.lit(1e1) * band + F.lit(5e0) + ((user % 7) - 3) * F.lit(0.9e0) + km / F.lit(4e2)
        ).alias("lng"),
        F.lit(0).alias("zero_col"),
        F.col("value").alias("alt"),
        (F.col("t") / F.lit(8.64e4)).alias("dayno"),
        at.cast("date").alias("event_date"),
        F.date_format(at, "HH:mm:ss").alias("event_time"),
        at.alias("event_timestamp"),
    )


def _nation_code(key: Column) -> Column:
    return F.concat(F.lit("N"), F.chr(key + 65))


def country_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference names of all nations but the last."""
    nation = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") != 24)
    return nation.select(
        _nation_code(F.col("n_nationkey")).alias("iso_code"),
        F.col("n_name").alias("english_name"),
        F.concat(F.lit("Republic of "), F.col("n_name")).alias("official_name"),
    )


def customer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a country code of the full reference; every 199th has an unknown one."""
    codes = [line.split("|")[0] for line in COUNTRY_NAMES.strip().splitlines()] + ["ZZ"]
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key, _choose(key % len(codes), codes).alias("iso_code")
    )


def division_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond of radius 2.5 degrees for each nation, as stored: GeoJSON and JSON text."""
    key = F.col("n_nationkey")
    x = F.expr("n_nationkey div 5") * F.lit(1e1) + F.lit(5e0)
    y = (key % 5) * F.lit(1e1) + F.lit(5e0)
    r = F.lit(2.5e0)
    corners = [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("d"), key.cast("string")).alias("id"),
        _nation_code(key).alias("country"),
        F.to_json(F.struct(F.col("n_name").alias("primary"))).alias("names"),
        geo.geojson("Polygon", F.array(F.array(*[F.array(px, py) for px, py in corners]))).alias("geometry"),
        F.struct(
            (x - r).alias("xmin"), (x + r).alias("xmax"), (y - r).alias("ymin"), (y + r).alias("ymax")
        ).alias("bbox"),
        F.when(key == 23, "region").otherwise("country").alias("subtype"),
        F.when(key == 22, "maritime").otherwise("land").alias("class"),
        F.lit(None).cast("string").alias("region"),
    )
    return rows


# Tag lists by p_partkey % 5.
TAGS = [
    '{"key_value":[{"key":"hgv","value":"yes"},{"key":"fee","value":"no"}]}',
    '{"key_value":[{"key":"hgv","value":"designated"}]}',
    '{"key_value":[{"key":"hgv","value":"no"}]}',
    '{"key_value":[{"key":"hgv","value":"yes"},{"key":"hgv","value":"designated"}]}',
    '{"key_value":[]}',
]


def infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    x = (key * 7919 % 50000) / F.lit(1e3)
    y = (key * 104729 % 50000) / F.lit(1e3)
    h = F.lit(0.2e0)
    square = geo.box(x - h, y - h, x + h, y + h)
    kind = F.when(key % 7 == 0, "Point").when(key % 11 == 0, "MultiPolygon").otherwise("Polygon")
    shape = (
        F.when(kind == "Point", geo.geojson("Point", F.array(x, y)))
        .when(kind == "MultiPolygon", geo.geojson("MultiPolygon", F.array(square)))
        .otherwise(geo.geojson("Polygon", square))
    )
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        _choose(key % 4, ["parking", "Parking_lot", "bridge", "bicycle_parking"]).alias("class"),
        _choose(key % 3, ["TRANSIT", "transit", "airport"]).alias("subtype"),
        shape.alias("geometry"),
        _choose(key % 5, TAGS).alias("source_tags"),
    )


STORE_NAMES = [
    "REWE City", "Lidl", "Aldi Nord", "netto Marken", "Penny", "EDEKA", "Rewe-Netto",
    "Renaldi Cafe", "Bakery",
]
STORE_CATEGORIES = ["supermarket", "grocery_store", "discount_store", "restaurant"]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")

    def primary(value: Column) -> Column:
        return F.to_json(F.struct(value.alias("primary")))

    country = F.concat(F.lit('[{"country":"'), _nation_code(F.col("c_nationkey")), F.lit('"}]'))
    x, y = (key * 6151 % 50000) / F.lit(1e3), (key * 3571 % 50000) / F.lit(1e3)
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        geo.geojson("Point", F.array(x, y)).alias("geometry"),
        primary(_choose(key % 9, STORE_NAMES)).alias("names"),
        primary(_choose(key % 4, STORE_CATEGORIES)).alias("categories"),
        country.alias("addresses"),
    )


def shaped_areas(spark: SparkSession, sf_dir: str, turn: float = 0e0) -> DataFrame:
    """Stored areas with holes and several parts, ``turn`` degrees to the east.

    Each nation's diamond of radius 4 has a hole of radius 1.5, which runs the other way around
    for every second nation; every third nation also has a diamond of radius 0.7 in the middle of
    the hole, as a second part. Longitudes beyond 180 start anew at -180.
    """
    key = F.col("n_nationkey")
    x0, y = F.expr("n_nationkey div 5") * F.lit(1e1) + F.lit(5e0), (key % 5) * F.lit(1e1) + F.lit(5e0)

    def turned(x: Column) -> Column:
        return F.pmod(x + F.lit(turn + 180e0), F.lit(360e0)) - F.lit(180e0)

    def diamond(r: float, clockwise: Column) -> Column:
        d = F.lit(r)
        corners = [F.array(turned(px), py) for px, py in ((x0 + d, y), (x0, y + d), (x0 - d, y), (x0, y - d))]
        ring = F.array(*corners, corners[0])
        return F.when(clockwise, F.reverse(ring)).otherwise(ring)

    holed = F.array(diamond(4e0, F.lit(False)), diamond(1.5e0, key % 2 == 0))
    parts = F.array(holed, F.array(diamond(0.7e0, F.lit(False))))
    shape = F.when(key % 3 == 0, geo.geojson("MultiPolygon", parts)).otherwise(geo.geojson("Polygon", holed))
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"), _nation_code(key).alias("country"),
        F.to_json(F.struct(F.col("n_name").alias("primary"))).alias("names"), shape.alias("geometry"),
        F.lit(None).cast("struct<xmin:double,xmax:double,ymin:double,ymax:double>").alias("bbox"),
        F.lit("country").alias("subtype"), F.lit("land").alias("class"), F.lit(None).cast("string").alias("region"),
    )


def hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per supplier, laid out in rows of ``HEX_COLUMNS``."""
    q = (F.col("s_suppkey") % HEX_COLUMNS).cast("int")
    r = F.expr(f"s_suppkey div {HEX_COLUMNS}").cast("int")
    return table(spark, sf_dir, "supplier").select(
        hex_id(q, r).alias("hex_id"), q.alias("q"), r.alias("r"),
        (r * F.lit(1.2e-2)).alias("latitude"),
        (q * F.lit(1.4e-2) + r * F.lit(0.7e-2)).alias("longitude"),
    )


def travel_matrix(cells: DataFrame) -> DataFrame:
    """All pairs of cells 1 to 10 rings apart; one pair in fifty has no duration."""
    end = cells.select(
        F.col("hex_id").alias("neighbor_hex"), F.col("q").alias("q2"), F.col("r").alias("r2")
    )
    start = cells.select("hex_id", F.col("q").alias("q1"), F.col("r").alias("r1"))
    pairs = join_lookup(hex_disk(cells, 10), end, ["neighbor_hex"], "inner", salt_by=["hex_id"])
    pairs = join_lookup(pairs, start, ["hex_id"], "inner", salt_by=["neighbor_hex"])
    ring = hex_distance(F.col("q1"), F.col("r1"), F.col("q2"), F.col("r2"))
    extra = F.pmod(F.col("q2") * 31 + F.col("r2") * 17, F.lit(10)) / F.lit(1e1)
    gap = F.col("q1") * 7 + F.col("r1") * 11 + F.col("q2") * 13 + F.col("r2") * 3
    return pairs.withColumn("ring", ring).filter("ring between 1 and 10").select(
        F.col("hex_id").alias("origin_hex"), F.col("neighbor_hex").alias("dest_hex"),
        (F.col("ring") * F.lit(0.8e0)).alias("distance_km"),
        F.when(F.pmod(gap, F.lit(50)) != 0, F.col("ring") * F.lit(2.5e0) + extra)
        .alias("duration_minutes"),
    )


def route_responses(points: DataFrame) -> DataFrame:
    """A stored response for each clean trip: its two ends, and a length and time by its points."""
    order = F.struct("event_timestamp", "event_id")
    here = F.array("lng", "lat")
    trips = points.groupBy("uid", "tid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(here, order).alias("start"), F.max_by(here, order).alias("stop"),
    )
    summary = F.struct(
        (F.col("n") * F.lit(137.5e0)).alias("distance"), (F.col("n") * F.lit(31.4e0)).alias("duration")
    )
    feature = F.struct(
        F.struct(
            F.lit("LineString").alias("type"), F.array("start", "stop").alias("coordinates")
        ).alias("geometry"),
        F.struct(summary.alias("summary")).alias("properties"),
    )
    rows = trips.select(
        "uid", "tid", F.lit(DEFAULT_PROFILE).alias("profile"),
        F.to_json(F.struct(F.array(feature).alias("features"))).alias("response"),
    )
    return as_variants(rows, "response")
