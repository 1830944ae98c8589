"""Percentiles, trip statistics and the mode ladder."""

import pytest
from frames import at, rows

from tripweave.operators.trajectory import find_hot_trips
from tripweave.operators.trips import attach_trip_mode, classify_trips, trip_modes, trip_statistics


def speeds(spark, trips):
    data = [(u, t, s, at(i)) for (u, t), values in trips.items() for i, s in enumerate(values)]
    return spark.createDataFrame(
        data, "uid string, tid string, speed double, event_timestamp timestamp"
    )


@pytest.mark.parametrize("limit", [1, 10**6])
def test_statistics_of_short_and_empty_trips(spark, limit):
    df = speeds(spark, {("a", "1"): [4.0], ("a", "2"): [None], (None, "3"): [1.0, 2.0]})
    hot = find_hot_trips(df, limit)
    assert hot.any == (limit == 1)
    got = {(r.uid, r.tid): r for r in trip_statistics(df, hot).collect()}
    assert set(got) == {("a", "1"), (None, "3")}
    assert got["a", "1"].stddev_speed is None and got["a", "1"].median_speed == 4.0
    assert got[None, "3"].avg_speed == 1.5 and got[None, "3"].p25_speed == 1.25


def test_trip_without_speed_has_no_mode(spark):
    df = speeds(spark, {("a", "1"): [4.0, 5.0], ("a", "2"): [None]})
    marked = attach_trip_mode(df, trip_modes(df))
    got = set(rows(marked, "tid", "transportation_mode", "trip_avg_speed"))
    assert got == {("1", "walking", 4.5), ("2", None, None)}


def test_mode_ladder_at_its_limits(spark):
    cases = [
        (0.99, 500, 0, "stationary"), (1, 14.99, 0, "walking"), (1, 15, 0, "unknown"),
        (5.99, 14.99, 0, "walking"), (6, 19.99, 0, "running"), (6, 20, 0, "unknown"),
        (7.99, 30, 0, "unknown"), (8, 44.99, 0, "cycling"), (11.99, 19.99, 0, "running"),
        (12, 19.99, 0, "cycling"), (12, 45, 0, "unknown"), (15, 45, 0, "driving_urban"),
        (24.99, 44.99, 0, "cycling"), (25, 44.99, 0, "driving_urban"),
        (40, 100, 59.99, "driving_urban"), (40, 100, 60, "driving_highway"),
        (60, 100, 80.01, "driving_highway"), (60.01, 100, 80, "driving_highway"),
        (60.01, 100, 80.01, "train_airplane"), (79.99, 100, 59, "driving_urban"),
        (80, 100, 0, "train_airplane"), (39.99, 100, 70, "driving_urban"),
    ]
    df = spark.createDataFrame(
        [("u", str(i), 1, float(a), float(m), float(d)) for i, (a, m, d, _) in enumerate(cases)],
        "uid string, tid string, point_count long, avg_speed double, max_speed double, "
        "median_speed double",
    )
    got = {int(r.tid): r.transportation_mode for r in classify_trips(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
