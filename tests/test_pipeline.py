"""Readers, stages, the whole pipeline, and the shape of plans."""

import re

import pytest
from frames import rows

from tripweave import schemas
from tripweave.operators.routes import route_summary
from tripweave.operators.segments import trip_segments
from tripweave.operators.trajectory import HotTrips, drop_outlier_trips, find_hot_trips
from tripweave.plans import pipeline
from tripweave.session import shared_dir, size_shuffle
from tripweave.sources import readers, sample_inputs
from tripweave.sources.stages import read_stage


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The derived inputs as Parquet files, nested columns as JSON text."""
    root = str(tmp_path_factory.mktemp("inputs"))
    made = {
        "points": sample_inputs.gps_points(spark, sf_dir),
        "divisions": sample_inputs.division_area(spark, sf_dir),
        "infrastructure": sample_inputs.infrastructure(spark, sf_dir),
        "places": sample_inputs.places(spark, sf_dir),
        "hexagons": sample_inputs.hexagons(spark, sf_dir),
        "matrix": sample_inputs.travel_matrix(sample_inputs.hexagons(spark, sf_dir)),
        "responses": sample_inputs.route_responses(sample_inputs.gps_points(spark, sf_dir)),
    }
    for name, df in made.items():
        text = {
            f.name: f"to_json({f.name})" for f in df.schema.fields
            if f.dataType.simpleString() == "variant"
        }
        df.selectExpr(*[f"{text.get(c, c)} AS {c}" for c in df.columns]).write.parquet(
            f"{root}/{name}"
        )
    return root


def pipeline_inputs(spark, stored, sf_dir):
    return pipeline.Inputs(
        points=readers.read_points(spark, f"{stored}/points"),
        divisions=readers.read_divisions(spark, f"{stored}/divisions"),
        reference=sample_inputs.country_reference(spark, sf_dir),
        infrastructure=readers.read_infrastructure(spark, f"{stored}/infrastructure"),
        places=readers.read_places(spark, f"{stored}/places"),
        store_country="NATION_3",
    )


def test_readers(spark, stored, sf_dir):
    assert readers.read_points(spark, f"{stored}/points").count() == 1000
    assert readers.read_hexagons(spark, f"{stored}/hexagons").count() == 10
    assert readers.read_matrix(spark, f"{stored}/matrix").count() == 90
    routes = route_summary(readers.read_route_responses(spark, f"{stored}/responses"))
    assert routes.filter("distance_km > 0 AND duration_minutes > 0").count() == 75


def test_wrong_schema_is_named(spark, stored):
    with pytest.raises(ValueError, match="tid string"):
        schemas.require_columns(
            spark.read.parquet(f"{stored}/points").drop("tid"), schemas.POINTS
        )


def test_pipeline_twice_gives_the_same(spark, stored, sf_dir, tmp_path):
    inputs = pipeline_inputs(spark, stored, sf_dir)
    first = pipeline.run_pipeline(spark, inputs, str(tmp_path))
    names = [n for n in first if n not in ("country_cover", "countries")]
    before = {n: rows(first[n].drop("addresses")) for n in names}
    assert before["hgv_parkings"] and before["retail_stores"]
    assert len(before["points_mode"]) == len(before["points_clean"])
    pipeline.run_pipeline(spark, inputs, str(tmp_path))
    assert {n: rows(read_stage(spark, str(tmp_path), n).drop("addresses")) for n in names} == before


def test_shared_folder_is_read_from_the_session(spark):
    folder = shared_dir(spark)
    assert folder and shared_dir(spark) == folder


def test_shuffle_size_never_shrinks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffle(spark, 10**12) == -(-10**12 // (128 * 1024**2))
        assert size_shuffle(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_clean_points_shuffle_once(spark, sf_dir):
    points = sample_inputs.gps_points(spark, sf_dir)
    text = plan(drop_outlier_trips(points, hot=HotTrips(10**6)))
    assert len(exchanges(text)) == 1 and text.count("FileScan") == 1
    assert "SinglePartition" not in text and "NestedLoop" not in text


def test_segments_shuffle_once(spark, stored, sf_dir):
    points = sample_inputs.gps_points(spark, sf_dir).selectExpr(
        "*", "0L AS time_lag", "0e0 AS speed", "uid AS country_code"
    )
    text = plan(trip_segments(points, hot=HotTrips(10**6)))
    assert len(exchanges(text)) == 1 and "SinglePartition" not in text


def test_hot_trips_never_meet_in_one_task(spark, sf_dir):
    points = sample_inputs.gps_points(spark, sf_dir)
    hot = find_hot_trips(points, 6)
    text = plan(drop_outlier_trips(points, hot=hot))
    for keys in exchanges(text):
        if "_slice" not in keys:
            # By trip alone only tables of slices are shuffled, never points.
            assert keys.startswith("_uid")
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_point_join_is_an_equi_join(spark, stored, sf_dir):
    points = sample_inputs.gps_points(spark, sf_dir)
    areas = readers.read_divisions(spark, f"{stored}/divisions")
    countries = pipeline.build_countries(areas, sample_inputs.country_reference(spark, sf_dir))
    text = plan(pipeline.points_country(points, countries))
    assert "BroadcastHashJoin [_ci" in text
    assert "NestedLoop" not in text and "CartesianProduct" not in text
