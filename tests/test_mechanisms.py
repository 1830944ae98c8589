"""Hot keys, bounded percentiles, labels in one shuffle, versions of stages, buckets and the cube."""

import random
import re

import numpy as np
import pytest
from frames import at, rows
from pyspark.sql import functions as F

from tripweave.operators import cube, summary
from tripweave.operators.joins import hot_keys, join_lookup, measured_bytes
from tripweave.operators.percentiles import exact_percentiles
from tripweave.operators.trajectory import HotTrips, drop_outlier_trips, find_hot_trips, speed_points
from tripweave.operators.trips import attach_trip_mode, label_points, trip_modes, trip_statistics
from tripweave.plans.catalog import ORIGIN, Stages, prepare
from tripweave.session import shared_dir
from tripweave.sources import sample_inputs
from tripweave.sources.stages import (
    current_version,
    read_bucketed,
    read_stage,
    write_bucketed,
    write_stage,
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def buckets_read(df) -> str:
    """How many buckets the scan of a bucketed table selects."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        return re.search(r"SelectedBucketsCount: (\d+ out of \d+)", plan(df.select("*")))[1]
    finally:
        conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


# Hot keys.


def test_only_hot_keys_are_copied(spark):
    left = spark.range(9000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 97 = 1 THEN NULL ELSE id END AS k", "id % 5 AS v"
    )
    right = spark.range(20_000).selectExpr("id AS k", "id * 2 AS w").union(spark.range(1).selectExpr("NULL", "0L"))
    assert hot_keys(left, ["k"]) == [spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]]
    for how in ("left", "inner"):
        plain = left.join(right, "k", how).select("id", "k", "v", "w")
        salted = join_lookup(left, right, ["k"], how, limit=0)
        assert rows(salted, "id", "k", "v", "w") == rows(plain)
    copies = [x for x in plan(join_lookup(left, right, ["k"], "inner", limit=0)).split("\n") if "Generate explode" in x]
    assert len(copies) == 1
    own = F.when(F.xxhash64("k").isin(hot_keys(left, ["k"])), F.lit(32)).otherwise(F.lit(1))
    assert right.select(F.sum(own)).first()[0] < 20_001 + 40


def test_many_even_keys_are_not_hot(spark):
    assert hot_keys(spark.range(50_000).selectExpr("id AS k"), ["k"]) == []
    assert hot_keys(spark.range(0).selectExpr("id AS k"), ["k"]) == []


# Percentiles.


@pytest.mark.parametrize("limit", [1, 7, 10**6])
def test_percentiles_equal_numpy_and_spark(spark, limit):
    r = random.Random(3)
    values = {
        "one": [5.5], "two": [1.0, 2.0], "same": [0.0] * 50,
        "many": [r.choice([0.0, r.random() * 150, float(r.randrange(9))]) for _ in range(501)],
        "signed": [r.uniform(-20, 20) for _ in range(40)],
        # All but two values within one millionth.
        "close": [100 + r.random() * 1e-6 for _ in range(300)] + [0.0, 1e5],
        "next": [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(1.0, 0))] * 20,
        "huge": [1e308, -1e308, 0.0, 5e-324, 1e-300] * 3,
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None, float("nan")]], "k string, v double")
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {x.k: x for x in exact_percentiles(df, ["k"], "v", wanted, limit).collect()}
    assert set(got) == set(values)
    plain = df.where("NOT isnan(v)").groupBy("k").agg(F.percentile("v", list(wanted.values())).alias("q"))
    for x in plain.collect():
        assert [got[x.k][n] for n in wanted] == x.q, x.k


def test_a_hot_trip_of_one_speed_bucket_is_cut(spark):
    """All speeds lie within a hundredth: no task may sort more than a few of them."""
    r = random.Random(4)
    data = [("a", "1", 50 + r.random() / 100, at(i), i) for i in range(3000)]
    df = spark.createDataFrame(data, "uid string, tid string, speed double, event_timestamp timestamp, event_id long")
    hot = find_hot_trips(df, 100)
    assert hot.any
    assert rows(trip_statistics(df, hot, rows=20)) == rows(trip_statistics(df, HotTrips(10**6)))


# Labels.


def classified(spark, n=600):
    r = random.Random(8)
    data = []
    for i in range(n):
        hot = r.random() < 0.4
        uid, tid = ("hot", "1") if hot else (r.choice(["a", "b", None]), r.choice(["1", "2", None]))
        speed = r.choice([None, 0.0, r.random() * 90, -1.0]) if uid != "b" else None
        data.append((uid, tid, speed, at(r.randrange(500)), i))
    return spark.createDataFrame(data, "uid string, tid string, speed double, event_timestamp timestamp, event_id long")


@pytest.mark.parametrize("limit", [30, 10**6])
def test_labels_equal_statistics_joined(spark, limit):
    df = classified(spark)
    hot = find_hot_trips(df, limit)
    assert hot.any == (limit == 30)
    want = attach_trip_mode(df, trip_modes(df, HotTrips(10**6)), HotTrips(10**6))
    assert rows(label_points(df, hot, rows=10)) == rows(want)


def test_points_move_once_by_trip(spark, sf_dir):
    points = sample_inputs.gps_points(spark, sf_dir).withColumn("speed", F.col("alt"))
    text = plan(label_points(points, HotTrips(10**6)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text


# Positions that are none.


def test_positions_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", "1", i, at(10 * i), lat, 2.0) for i, lat in enumerate([1.0, nan, 1.0001, None, inf, 1.0002])]
    df = spark.createDataFrame(data, "uid string, tid string, event_id long, event_timestamp timestamp, lat double, lng double")
    got = {r.event_id: r.speed for r in speed_points(df).collect()}
    # No speed at such a point unless the one before has no position either, none after it.
    assert [got[i] for i in range(6)] == [0.0, None, 0.0, None, 0.0, 0.0]
    assert drop_outlier_trips(df).count() == 6


# Stages.


def test_a_failed_write_leaves_the_stage(spark, tmp_path):
    root = str(tmp_path)
    write_stage(spark.range(5), root, "numbers")
    before = current_version(spark, root, "numbers")
    with pytest.raises(Exception, match="broken"):
        write_stage(spark.range(5).selectExpr("if(id > 3, raise_error('broken'), id) AS id"), root, "numbers")
    assert current_version(spark, root, "numbers") == before and read_stage(spark, root, "numbers").count() == 5
    with pytest.raises(FileNotFoundError, match="other"):
        read_stage(spark, root, "other")


def test_a_stage_may_be_made_from_its_last_version(spark, tmp_path):
    root = str(tmp_path)
    stage = write_stage(spark.range(10), root, "numbers")
    for _ in range(4):
        stage = write_stage(stage.selectExpr("id + 1 AS id"), root, "numbers")
    assert rows(read_stage(spark, root, "numbers")) == rows(spark.range(4, 14))
    assert len([p for p in (tmp_path / "numbers").iterdir() if p.name.startswith("v-")]) == 2


def test_ranges_of_a_clustered_stage_do_not_overlap(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(id * 7919 % 500 AS int) AS k", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stage = write_stage(df, str(tmp_path), "sorted", ["k", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = stage.selectExpr("k * 10000L + id AS x", "input_file_name() AS f").groupBy("f").agg(F.min("x"), F.max("x"))
    spans = sorted((r[1], r[2]) for r in spans.collect())
    assert len(spans) > 1 and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_one_bucket_is_read_for_one_key(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('h', id % 50) AS k", "id")
    write_bucketed(df, str(tmp_path), "pairs", "k", 8)
    spark.sql(f"DROP TABLE {spark.catalog.listTables(pattern='bucketed_*')[-1].name}")
    # As another session does, which finds the stage by its pointer alone.
    table = read_bucketed(spark, str(tmp_path), "pairs", "k", 8)
    assert table.count() == 1000
    one = table.where("k = 'h7'")
    assert one.count() == 20 and buckets_read(one) == "1 out of 8"
    assert "Exchange" not in plan(table.groupBy("k").count())


def test_one_origin_reads_one_bucket(spark, sf_dir):
    from tripweave.operators.hex_travel import travel_times

    stages = Stages.of(prepare(spark), sf_dir)
    matrix, cells = stages.get(spark, "travel_matrix"), stages.get(spark, "hexagons")
    text = plan(travel_times(matrix, cells, k=5, origin=ORIGIN))
    assert "Exchange hashpartitioning" not in text
    assert buckets_read(matrix.where(F.col("origin_hex") == ORIGIN)) == "1 out of 16"


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


# Cube.


def grain(spark):
    r = random.Random(6)
    data = []
    for i in range(400):
        uid = r.choice(["a", "b", "c-1", None])
        tid = r.choice(["1", "2", "1-2", None])
        avg = r.choice([None, 5.25, 70.5])
        data.append((uid, tid, r.choice(["walking", "cycling", None]), r.choice(["X", "Y", None]), avg, avg, avg, float(r.randrange(90))))
    points = spark.createDataFrame(data, ", ".join(f"{k} {'string' if i < 4 else 'double'}" for i, k in enumerate(summary.GRAIN_KEYS)) + ", speed double")
    return summary.trip_grain(points)


@pytest.mark.parametrize("chosen", [{}, {"users": ["a", "c-1"]}, {"modes": ["walking"], "countries": ["X"]}, {"users": ["zz"]}])
def test_cube_equals_the_grain(spark, chosen):
    store = {}

    def keep(df, name):
        store[name] = df.checkpoint()
        return store[name]

    whole = grain(spark)
    made = cube.facet_cube(whole, keep)
    some, few = summary.facet_filter(made, **chosen), summary.facet_filter(whole, **chosen)
    for name in ("overview", "mode_distribution", "top_countries", "mode_by_country", "speed_by_mode_country"):
        assert rows(getattr(cube, name)(some)) == rows(getattr(summary, name)(few)), name


def test_cube_queries_read_once_and_expand_nothing(spark, sf_dir):
    made = Stages.of(prepare(spark), sf_dir).get(spark, "facet_cube")
    text = plan(cube.overview(summary.facet_filter(made, modes=["walking"])))
    assert "Expand" not in text and text.count("FileScan") == 1 and "PushedFilters: [IsNotNull(transportation_mode)" in text


def test_sets_of_a_cube_are_no_larger_than_its_grain(spark):
    """Many users of few trips: a set is a word, and the trips of a user lie in one or two of them."""
    trips = spark.range(6000, numPartitions=6).selectExpr(
        "concat('u', id % 500) AS uid", "cast(id AS string) AS tid",
        "if(id % 2 = 0, 'walking', 'cycling') AS transportation_mode", "'X' AS country_name",
        "4.0d AS trip_avg_speed", "5.0d AS trip_max_speed", "4.0d AS trip_median_speed",
        "10L AS points", "10L AS speed_count", "40.0d AS speed_sum", "5.0d AS speed_max",
    )
    store = {}

    def keep(df, name):
        store[name] = df.checkpoint()
        return store[name]

    made = cube.facet_cube(trips, keep).where("kind <> 'sums'").select(*cube.FACETS, "kind", "bucket", "bitmap").checkpoint()
    assert made.where("kind = 'trip'").count() <= 2 * 500
    assert measured_bytes(made) < measured_bytes(trips) / 2
    numbers = store["numbers_trip_number"].orderBy("trip_number").collect()
    assert [r["_value"] for r in numbers] == sorted(r["_value"] for r in numbers) and len(numbers) == 6000
    assert rows(cube.mode_by_country(cube.facet_cube(trips, keep))) == rows(summary.mode_by_country(trips))
