"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as registry
from tripweave.operators.trajectory import find_hot_trips
from tripweave.plans.catalog import Stages
from tripweave.sources import sample_inputs

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


@pytest.fixture(scope="module")
def cut_trips(spark, sf_dir):
    """Other stages of the same tables, where every trip of more than six points is hot."""
    key = (spark.sparkContext.applicationId, sf_dir)
    before = Stages._known.get(key)
    stages = Stages(spark, sf_dir)
    stages._hot = find_hot_trips(sample_inputs.gps_points(spark, sf_dir), 6)
    Stages._known[key] = stages
    yield stages._hot
    if before is None:
        del Stages._known[key]
    else:
        Stages._known[key] = before


ON_POINTS = [
    "speed_points", "outlier_trips", "points_clean", "trip_statistics", "points_mode",
    "trip_segments", "trip_metrics", "trip_endpoints",
]


@pytest.mark.parametrize("name", ON_POINTS)
def test_query_equals_sql_when_trips_are_cut(spark, con, sf_dir, cut_trips, name):
    assert cut_trips.trips.count() > 50
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


def test_entry(spark):
    result = registry.entry(spark)
    assert result.columns == ["transportation_mode", "trip_count", "avg_speed"]
    assert {r[0]: r[1] for r in result.collect()} == {
        "stationary": 10, "walking": 10, "running": 10, "cycling": 14,
        "driving_urban": 10, "driving_highway": 10, "train_airplane": 10,
    }
