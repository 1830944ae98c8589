"""Time gap, speed and outlier removal, against the plain one-window form."""

import random

import pytest
from frames import points, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripweave.functions.geo import haversine_m
from tripweave.functions.numbers import seconds_between
from tripweave.operators.trajectory import (
    attach_to_trips,
    drop_outlier_trips,
    find_hot_trips,
    outlier_trips,
    speed_points,
    with_slice_key,
)


def plain_speeds(df):
    """One window per trip, as the definition has it; fit for small trips only."""
    w = Window.partitionBy("uid", "tid").orderBy(
        F.col("event_timestamp").asc_nulls_last(), "event_id"
    )
    gap = seconds_between(F.col("pt"), F.col("event_timestamp"))
    metres = haversine_m(F.col("pl"), F.col("pg"), F.col("lat"), F.col("lng"))
    return (
        df.withColumns({
            "pt": F.lag("event_timestamp").over(w), "pl": F.lag("lat").over(w),
            "pg": F.lag("lng").over(w),
        })
        .withColumn("time_lag", F.coalesce(gap, F.lit(0)).cast("long"))
        .withColumn(
            "speed",
            F.when(F.col("pl").isNull() | F.col("pg").isNull() | (gap == 0), F.lit(0e0))
            .otherwise(metres / gap * 3.6),
        )
        .drop("pt", "pl", "pg")
    )


def plain_clean(df):
    speeds = plain_speeds(df)
    bad = speeds.filter("speed > 200").select("uid", "tid").distinct()
    return speeds.join(bad, ["uid", "tid"], "left_anti").select(*df.columns, "time_lag", "speed")


def assert_same_speeds(ours, plain):
    key = ("event_id", "uid", "tid", "time_lag")
    a = sorted(ours.select(*key, "speed").collect(), key=repr)
    b = sorted(plain.select(*key, "speed").collect(), key=repr)
    assert [r[:4] for r in a] == [r[:4] for r in b]
    for x, y in zip(a, b):
        same = x.speed == y.speed or abs(x.speed - y.speed) < 1e-9 * (1 + abs(y.speed))
        assert same, (x, y)


def random_rows(seed, n=400):
    """One trip holds a third of all points; keys, times and places are missing here and there."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.34
        uid = "hot" if hot else r.choice(["a", "b", "c", None])
        tid = "1" if hot else r.choice(["1", "2", None])
        t = None if r.random() < 0.03 else r.choice([r.randrange(600), r.randrange(600) + 0.5])
        lat = None if r.random() < 0.05 else 10 + r.random() * (0.5 if uid == "c" else 0.01)
        out.append((uid, tid, i, t, lat, 20 + r.random() * 0.01))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [5, 60, 10**6])
def test_slices_equal_one_window(spark, seed, limit):
    df = points(spark, random_rows(seed))
    hot = find_hot_trips(df, limit)
    assert hot.any == (limit < 10**6)
    assert_same_speeds(speed_points(df, hot=hot), plain_speeds(df))
    assert_same_speeds(drop_outlier_trips(df, hot=hot), plain_clean(df))


@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", None]), st.sampled_from(["1", "2"]),
            st.integers(0, 50), st.floats(0, 0.02),
        ),
        min_size=1, max_size=30,
    )
)
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_clean_equals_anti_join(spark, drawn):
    df = points(spark, [(u, t, i, s, lat, 1e0) for i, (u, t, s, lat) in enumerate(drawn)])
    assert_same_speeds(drop_outlier_trips(df, hot=find_hot_trips(df, 3)), plain_clean(df))


def test_jump_within_one_second_is_no_outlier(spark):
    df = points(spark, [("a", "1", 1, 10.1, 1e0, 1e0), ("a", "1", 2, 10.9, 1.5e0, 1e0)])
    assert rows(drop_outlier_trips(df), "event_id", "time_lag", "speed") == [(1, 0, 0.0), (2, 0, 0.0)]
    assert outlier_trips(df).count() == 0


def test_seconds_count_boundaries(spark):
    df = points(spark, [("a", "1", 1, 0.9, 1e0, 1e0), ("a", "1", 2, 1.1, 1e0, 1e0)])
    assert rows(speed_points(df), "event_id", "time_lag") == [(1, 0), (2, 1)]


def test_missing_position(spark):
    df = points(spark, [
        ("a", "1", 1, 0, 1e0, 1e0), ("a", "1", 2, 10, None, 1e0), ("a", "1", 3, 20, 1e0, 1e0),
    ])
    assert rows(speed_points(df), "event_id", "time_lag", "speed") == [
        (1, 0, 0.0), (2, 10, None), (3, 10, 0.0),
    ]
    assert drop_outlier_trips(df).count() == 3


def test_trips_without_key_stay(spark):
    fast = [(0, 1e0), (10, 2e0)]
    df = points(spark, [
        (u, t, i, s, lat, 1e0)
        for i, (u, t, (s, lat)) in enumerate(
            (u, t, p) for u, t in ((None, "1"), ("a", None), ("a", "1")) for p in fast
        )
    ])
    kept = {(r.uid, r.tid) for r in drop_outlier_trips(df, hot=find_hot_trips(df, 1)).collect()}
    assert kept == {(None, "1"), ("a", None)}


@pytest.mark.parametrize("limit", [20, 10**6])
def test_attach_to_trips_matches_left_join(spark, limit):
    df = points(spark, random_rows(5))
    trips = spark.createDataFrame(
        [("hot", "1", 1), ("a", "1", 2), (None, "1", 3), ("zz", "1", 4)],
        "uid string, tid string, mark int",
    )
    want = rows(df.join(trips, ["uid", "tid"], "left").select(*df.columns, "mark"))
    assert rows(attach_to_trips(df, trips, find_hot_trips(df, limit))) == want


def test_bursts_are_cut_again(spark):
    """A stray old point stretches the span of a trip; its crowded part is cut once more."""
    rows_ = [("a", "1", i, 1e6 + i, 1e0, 1e0) for i in range(200)] + [("a", "1", 999, -1e9, 1e0, 1e0)]
    df = points(spark, rows_)
    hot = find_hot_trips(df, 20)
    assert hot.trips.count() == 1 and hot.bursts.count() == 1
    sizes = [r["count"] for r in with_slice_key(df, hot).groupBy("_slice").count().collect()]
    assert sum(sizes) == 201 and max(sizes) <= 20
    assert_same_speeds(speed_points(df, hot=hot), plain_speeds(df))


def test_moments_are_cut_by_the_tie(spark):
    """Points of one time, and points without a time, are cut by the tie column."""
    rows_ = [("a", "1", i * 7 % 300, 5.0 if i < 200 else None, 1e0 + i / 1e4, 1e0) for i in range(300)]
    df = points(spark, rows_ + [("a", "1", 900, 0.0, 1e0, 1e0), ("a", "1", 901, 9.0, 1e0, 1e0)])
    hot = find_hot_trips(df, 20)
    assert hot.moments.count() == 2
    sizes = [r["count"] for r in with_slice_key(df, hot).groupBy("_slice").count().collect()]
    assert sum(sizes) == 302 and max(sizes) <= 20
    assert_same_speeds(speed_points(df, hot=hot), plain_speeds(df))
    assert_same_speeds(drop_outlier_trips(df, hot=hot), plain_clean(df))
