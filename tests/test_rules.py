"""Rule ladders, lookups, nested reads and number functions."""

import pytest
from frames import at, rows
from pyspark.sql import functions as F

from tripweave.functions import geo, numbers, rules
from tripweave.functions.nested import match_any, path_str
from tripweave.operators.pois import explode_tags


def one_column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_time_band(spark):
    values = [-1.0, 0.0, 2.99, 3.0, 23.99, 24.0, 27.0, 1e6, None, float("nan")]
    colours, grey = rules.TIME_COLOURS, rules.NO_TIME_COLOUR
    want = [colours[i] for i in (0, 0, 0, 1, 7, 8, 8, 8)] + [grey, grey]
    assert results(one_column(spark, values, "double"), rules.time_band(F.col("v"))) == want


def test_speed_band(spark):
    values = [60.01, 60.0, 30.01, 30.0, 10.01, 10.0, None]
    c, slow = [b for _, b in rules.SPEED_COLOURS], rules.SLOW_COLOUR
    want = [c[0], c[1], c[1], c[2], c[2], slow, slow]
    assert results(one_column(spark, values, "double"), rules.speed_band(F.col("v"))) == want


def test_brand_precedence(spark):
    names = ["REWE City", "Rewe-Netto", "netto Penny", "Renaldi", "Bakery", None, "my EDEKA lidl"]
    want = ["REWE", "REWE", "NETTO", "ALDI", None, None, "LIDL"]
    assert results(one_column(spark, names, "string"), rules.canonical_brand(F.col("v"))) == want


def test_profile_lookup(spark):
    modes = ["car", "bike", "walk", "run", "walking", "cycling", None]
    want = ["driving-car", "cycling-electric", "foot-walking", "foot-walking"] + ["driving-car"] * 3
    assert results(one_column(spark, modes, "string"), rules.route_profile(F.col("v"))) == want


def test_match_any(spark):
    df = one_column(spark, ["Parking", "parking_lot", "bicycle_parking"], "string")
    assert results(df, match_any(F.col("v"), ["parking%", "x"])) == [True, True, False]


def test_rounding_at_halves(spark):
    df = one_column(spark, [0.25, 0.35, 1.115, -0.25, 0.285], "double")
    assert results(df, numbers.round_half_even(F.col("v"), 1)) == [0.2, 0.4, 1.1, -0.2, 0.3]
    assert results(df, numbers.round_half_up(F.col("v"), 1)) == [0.3, 0.4, 1.1, -0.3, 0.3]
    assert results(df, numbers.round_half_up(F.col("v"), 2)) == [0.25, 0.35, 1.12, -0.25, 0.29]


def test_whole_metres_and_seconds(spark):
    df = one_column(spark, [1237.5, 1234.4, None], "double")
    assert results(df, numbers.as_km(F.col("v"))) == [1.24, 1.23, None]
    assert results(df, numbers.as_minutes(F.col("v"))) == [20.63, 20.57, None]


def test_seconds_between_counts_boundaries(spark):
    df = spark.createDataFrame([(at(0.9), at(1.1)), (at(1.1), at(1.9))], "a timestamp, b timestamp")
    got = df.select(numbers.seconds_between(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1, 0]


def test_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 1.0, 0.0), (None, 0.0, 1.0, 0.0)],
                               "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine_m(*map(F.col, "abcd"))).collect()]
    assert got[0] == pytest.approx(20015114.4, abs=1)
    assert got[1] == pytest.approx(111195.08, abs=0.1)
    assert got[2] is None


def test_geojson_and_its_type(spark):
    df = spark.createDataFrame([(1.5, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    text = geo.geojson("LineString", geo.line(*map(F.col, "abcd")))
    row = df.select(text, geo.geom_type(text)).first()
    assert row[0] == '{"type":"LineString","coordinates":[[1.5,2.0],[3.0,4.0]]}'
    assert row[1] == "LineString"


def test_tags(spark):
    texts = [
        '{"key_value":[{"key":"hgv","value":"yes"},{"key":"fee","value":"no"}]}',
        '{"key_value":[]}', '{"other":1}', None,
    ]
    df = one_column(spark, texts, "string").withColumn("source_tags", F.try_parse_json("v")).drop("v")
    assert rows(explode_tags(df)) == [(0, "fee", "no"), (0, "hgv", "yes")]


def test_path_of_missing_name(spark):
    texts = ['{"primary":"A"}', '{"primary":7}', '{"common":{}}', "not json", None]
    df = one_column(spark, texts, "string").withColumn("p", F.try_parse_json("v"))
    assert results(df, path_str(F.col("p"), "$.primary")) == ["A", "7", None, None, None]
