"""Time the point pipeline on many copies of the test events, evenly spread or with a hot trip.

    python scale_bench.py COPIES [skew]

With ``skew`` every third point belongs to one trip. The copies are written to a new folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tripweave.operators import segments, summary
from tripweave.operators.spatial_join import cover
from tripweave.operators.trajectory import drop_outlier_trips, find_hot_trips, outlier_trips
from tripweave.plans import pipeline
from tripweave.plans.catalog import _countries
from tripweave.session import prepare
from tripweave.sources import sample_inputs as inputs
from tripweave.sources.stages import write_stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def copies_of_events(spark: SparkSession, copies: int, skew: bool, folder: str) -> None:
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    copy = F.col("copy")
    rows = events.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    user, ts = F.col("user_id") + copy * 3000, F.col("ts")
    if skew:
        hot = F.col("event_id") % 3 == 0
        # One user and one week: the seconds of the event, moved into the third week.
        week = F.timestamp_seconds(F.lit(2819 * 604800) + F.unix_seconds(ts.cast("timestamp")) % 604800)
        user = F.when(hot, F.lit(8)).otherwise(user)
        ts = F.when(hot, week.cast("timestamp_ntz")).otherwise(ts)
        # Without the large values that would make the trip an outlier and drop it.
        rows = rows.withColumn("value", F.when(hot, F.least("value", F.lit(3e2))).otherwise(F.col("value")))
    rows = rows.withColumns({
        "user_id": user, "ts": ts, "event_id": F.col("event_id") * copies + copy,
    }).drop("copy")
    rows.repartition(32).write.parquet(f"{folder}/events.parquet")


def main() -> None:
    copies, skew = int(sys.argv[1]), "skew" in sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "64")
        .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    copies_of_events(spark, copies, skew, folder)
    points = inputs.gps_points(spark, folder)
    times, stages = {}, f"{folder}/stages"

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 1)
        print(name, times[name], file=sys.stderr, flush=True)
        return out

    def write(name, df, cluster=None):
        return timed(name, lambda: write_stage(df(), stages, name, cluster))

    def drain(name, df):
        timed(name, lambda: df().write.format("noop").mode("overwrite").save())

    countries = write("countries", lambda: _countries(spark, SF_DIR))
    grid = write("country_cover", lambda: cover(countries))
    hot = timed("find_hot_trips", lambda: find_hot_trips(points))
    drain("outlier_trips", lambda: outlier_trips(points, hot=hot))
    clean = write("points_clean", lambda: drop_outlier_trips(points, hot=hot))
    tagged = write("points_country", lambda: pipeline.points_country(clean, countries, grid))
    classified = write("points_mode", lambda: pipeline.points_mode(tagged, hot), pipeline.TRIP_ORDER)
    grain = write("trip_grain", lambda: summary.trip_grain(classified))
    drain("overview", lambda: summary.overview(grain))
    drain("mode_distribution", lambda: summary.mode_distribution(grain))
    drain("speed_distribution", lambda: summary.speed_distribution(grain))
    drain("sample_trips", lambda: summary.sample_trips(grain))
    drain("trip_segments", lambda: segments.trip_segments(classified, hot=hot))
    drain("trip_metrics", lambda: segments.trip_metrics(classified, hot=hot))
    print(json.dumps({
        "copies": copies, "skew": skew, "points": spark.read.parquet(f"{folder}/events.parquet").count(),
        "clean_points": clean.count(), "trips": grain.select("uid", "tid").distinct().count(),
        "seconds": times,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
