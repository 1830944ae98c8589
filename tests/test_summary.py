"""Summaries on hand-made points: composed keys, ties, NULL order, weights."""

import pytest
from frames import rows
from pyspark.sql import functions as F

from tripweave.operators import summary
from tripweave.operators.countries import assert_unique, duplicate_keys
from tripweave.sources.country_names import country_reference

SCHEMA = (
    "uid string, tid string, transportation_mode string, country_name string, speed double, "
    "trip_avg_speed double, trip_max_speed double, trip_median_speed double"
)


def classified(spark, data):
    """Rows of (uid, tid, mode, country, speed, trip average)."""
    return spark.createDataFrame([(*r, r[5], r[5]) for r in data], SCHEMA)


SMALL = [
    ("1-2", "3", "walking", "A", 4.0, 4.0),
    ("1", "2-3", "walking", "B", 6.0, 6.0),
    ("1", "2-3", "walking", "A", 6.0, 6.0),
    ("9", "1", "cycling", None, 20.0, 20.0),
    ("9", "1", "cycling", "B", 20.0, 20.0),
    (None, "1", None, "B", None, None),
    ("7", "1", None, None, None, None),
]


@pytest.mark.parametrize("stored", [False, True])
def test_overview(spark, stored):
    points = classified(spark, SMALL)
    source = summary.trip_grain(points) if stored else points
    # The two composed ids '1-2-3' are one; a NULL key has no id.
    assert rows(summary.overview(source)) == [(7, 4, 3, 11.2, 20.0)]


def test_overview_of_nothing(spark):
    empty = classified(spark, SMALL).filter("uid = 'none'")
    assert rows(summary.overview(empty)) == [(0, 0, 0, None, None)]


def test_mode_average_is_weighted_by_points(spark):
    points = classified(spark, SMALL)
    assert [tuple(r) for r in summary.mode_distribution(points).collect()] == [
        ("cycling", 1, 20.0), ("walking", 1, 5.33),
    ]


def test_countries_count_border_trips_in_each(spark):
    points = classified(spark, SMALL)
    assert [tuple(r) for r in summary.top_countries(points).collect()] == [("B", 2, 3), ("A", 1, 2)]
    assert [tuple(r) for r in summary.top_countries(points, 1).collect()] == [("B", 2, 3)]


def test_mode_by_top_countries(spark):
    points = classified(spark, SMALL + [("8", "1", "running", "C", 9.0, 9.0)])
    got = [tuple(r) for r in summary.mode_by_top_countries(points, 2).collect()]
    # B has two trips; A and C have one each, the first name wins.
    assert got == [("A", "walking", 1), ("B", "cycling", 1), ("B", "walking", 1)]


def test_speed_by_mode_country_needs_enough_trips(spark):
    data = [(str(i), "1", "walking", "A", 4.0, 4.0 + i / 100) for i in range(5)]
    points = classified(spark, data + [("x", "1", "cycling", "A", 20.0, 20.0)])
    assert rows(summary.speed_by_mode_country(points)) == [("A", "walking", 4.02, 5)]
    assert summary.speed_by_mode_country(points, min_trips=1).count() == 2


def test_sample_trips_puts_missing_first_and_breaks_ties(spark):
    got = summary.sample_trips(classified(spark, SMALL), 4).collect()
    assert [(r.uid, r.tid, r.country_name) for r in got] == [
        ("7", "1", None), (None, "1", "B"), ("9", "1", "B"), ("9", "1", None),
    ]


def test_distribution_is_by_trip(spark):
    data = [("a", "1", "walking", "A", 1.0, 2.0)] * 9 + [("b", "1", "walking", "A", 1.0, 4.0)]
    got = rows(summary.speed_distribution(classified(spark, data)))
    assert got == [("walking", 2.0, 2.5, 3.0, 3.5, 4.0)]


def test_facets(spark):
    points = classified(spark, SMALL)
    assert summary.facet_filter(points).count() == 7
    assert summary.facet_filter(points, modes=["walking"], countries=["A"]).count() == 2
    assert summary.facet_filter(points, users=["9"], countries=[]).count() == 2
    assert [r[0] for r in summary.facet_values(points, "country_name").collect()] == ["A", "B"]
    assert [r[0] for r in summary.facet_values(points, "uid").collect()] == ["1", "1-2", "7", "9", None]


def test_trip_picker(spark):
    trips = summary.trip_list(classified(spark, SMALL))
    found = summary.trips_for(trips, "A", "walking")
    assert rows(found, "uid", "tid", "trips_found") == [("1", "2-3", 2), ("1-2", "3", 2)]
    assert summary.trips_for(trips).count() == 4


def test_composed_id_splits_into_keys(spark):
    df = spark.createDataFrame([("9-1",), ("1-2-3",), ("x",)], "id string")
    got = [tuple(r) for r in df.select(*summary.trip_keys(F.col("id"))).collect()]
    assert got == [("9", "1"), ("1", "2-3"), ("x", None)]


def test_key_checks(spark):
    names = country_reference(spark)
    assert assert_unique(names, ["iso_code"]).count() == 198
    longest = names.selectExpr(
        "max(length(iso_code))", "max(length(english_name))", "max(length(official_name))"
    ).first()
    assert longest[0] == 2 and longest[1] <= 100 and longest[2] <= 200
    twice = names.unionByName(names.filter("iso_code = 'FR'"))
    assert rows(duplicate_keys(twice, ["iso_code"])) == [("FR", 2)]
    with pytest.raises(ValueError, match="FR"):
        assert_unique(twice, ["iso_code"])
