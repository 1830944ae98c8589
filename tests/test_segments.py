"""Segments, trip metrics and extents on hand-made trips."""

import pytest
from frames import at, rows

from tripweave.operators.segments import trip_endpoints, trip_extent, trip_metrics, trip_segments
from tripweave.operators.trajectory import find_hot_trips

SCHEMA = (
    "uid string, tid string, event_id long, event_timestamp timestamp, lat double, lng double, "
    "speed double, time_lag long, country_code string"
)


def trip(spark, data):
    """Rows of (uid, tid, event_id, seconds, lat, lng, speed, time_lag, country)."""
    return spark.createDataFrame([(*r[:3], at(r[3]), *r[4:]) for r in data], SCHEMA)


DATA = [
    ("a", "1", 1, 0, 1.0, 1.0, 0.0, 0, "X"),
    ("a", "1", 2, 60, 1.1, 1.0, 36.0, 60, "X"),
    # The same point in two countries.
    ("a", "1", 3, 3660, 1.2, 1.0, 72.0, 3600, "X"),
    ("a", "1", 3, 3660, 1.2, 1.0, 72.0, 3600, "Y"),
    ("b", "1", 4, 0, 5.0, 5.0, 0.0, 0, None),
    (None, "1", 5, 0, 7.0, 7.0, None, 0, None),
    (None, "1", 6, 30, 7.0, 7.0, None, 30, None),
]


@pytest.mark.parametrize("limit", [1, 2, 10**6])
def test_segments(spark, limit):
    points = trip(spark, DATA)
    hot = find_hot_trips(points, limit)
    segments = trip_segments(points, hot=hot)
    got = rows(segments, "uid", "rn", "lat1", "lat2", "avg_speed", "segment_duration_seconds",
               "total_duration_seconds", "total_distance_km")
    # 18 km/h for a minute, 54 for an hour, and the doubled point's hour at 72 again.
    assert got == sorted([
        ("a", 1, 1.0, 1.1, 18.0, 60, 7260, 126.3),
        ("a", 2, 1.1, 1.2, 54.0, 3600, 7260, 126.3),
        ("a", 3, 1.2, 1.2, 72.0, 3600, 7260, 126.3),
        (None, 1, 7.0, 7.0, None, 30, 30, None),
    ], key=repr)
    colours = {r.rn: r.color for r in segments.filter("uid = 'a'").collect()}
    assert colours == {1: [255, 255, 0, 200], 2: [255, 165, 0, 200], 3: [255, 0, 0, 200]}
    metrics = rows(trip_metrics(points, hot=hot), "uid", "start_lat", "end_lat", "segments",
                   "total_duration_seconds", "total_duration_minutes", "total_distance_km")
    assert metrics == sorted([
        ("a", 1.0, 1.2, 3, 7260, 121.0, 126.3), (None, 7.0, 7.0, 1, 30, 0.5, None),
    ], key=repr)
    ends = rows(trip_endpoints(segments), "uid", "start_lat", "end_lat")
    assert ends == sorted([("a", 1.0, 1.2), (None, 7.0, 7.0)], key=repr)


def test_extent(spark):
    trips = spark.createDataFrame(
        [("p", "1", 1.0, 2.0, 1.0, 2.0), ("q", "1", 1.0, 5.0, 2.0, 3.0)],
        "uid string, tid string, start_lat double, start_lon double, end_lat double, end_lon double",
    )
    got = {r.uid: r for r in trip_extent(trips).collect()}
    p, q = got["p"], got["q"]
    assert (p.lat_padding, p.lon_padding, p.center_lat, p.zoom_level) == (0.01, 0.01, 1.0, 12)
    assert (q.min_lon, q.max_lon, q.center_lon) == (3.0, 5.0, 4.0)
    assert q.lat_padding == pytest.approx(0.15) and q.lon_padding == pytest.approx(0.3)
    assert q.zoom_level == 7
