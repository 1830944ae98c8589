"""The registered queries: each operator on inputs derived from the test tables.

Queries on classified points read stored stages, as users of the pipeline do. A stage is built
when first needed, once per application and input folder, in the folder all hosts share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import countries as co
from ..operators import hex_travel as hx
from ..operators import cube, pois, routes, segments, summary, trajectory, trips
from ..operators.joins import join_lookup
from ..operators.spatial_join import cover, join_intersects
from ..session import prepare, stage_dir
from ..sources import readers
from ..sources import sample_inputs as inputs
from ..sources.country_names import country_reference
from ..sources.stages import current_version, read_bucketed, read_stage, write_bucketed, write_stage
from . import pipeline

STORE_COUNTRY = "NATION_3"
FILTER_MODES = ["cycling", "driving_urban", "walking"]
#: Degrees by which areas and places are turned east, so that areas lie over the date line.
TURN = 160e0
MATRIX_BUCKETS = 16
PAIR = ("NATION_1", "cycling")
ONE_TRIP = ("3", "2818")
ORIGIN = "h_5_0"
FILTER_USERS = [str(i) for i in range(1, 150, 2)]
FILTER_COUNTRIES = ["NATION_1", "NATION_6", "NATION_12", "NATION_18"]


class Stages:
    """Stages of one input folder, built on demand."""

    _known: dict[tuple[str, str], Stages] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.root, self.sf_dir, self.built = stage_dir(spark), sf_dir, set()
        self._hot = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Stages:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def hot(self, spark: SparkSession) -> trajectory.HotTrips:
        if self._hot is None:
            self._hot = trajectory.find_hot_trips(inputs.gps_points(spark, self.sf_dir))
        return self._hot

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.built:
            cluster = pipeline.TRIP_ORDER if name == "points_mode" else None
            if name == "travel_matrix":
                write_bucketed(self._build(spark, name), self.root, name, "origin_hex", MATRIX_BUCKETS)
            else:
                write_stage(self._build(spark, name), self.root, name, cluster)
            self.built.add(name)
        if name == "travel_matrix":
            return read_bucketed(spark, self.root, name, "origin_hex", MATRIX_BUCKETS)
        return read_stage(spark, self.root, name)

    def stored(self, spark: SparkSession, name: str) -> str:
        """The folder of an input table in its stored shape, for the readers."""
        self.get(spark, name)
        return current_version(spark, self.root, name)

    def _build(self, spark: SparkSession, name: str) -> DataFrame:
        def stage(other: str) -> DataFrame:
            return self.get(spark, other)

        stored = {
            "division_area": inputs.division_area, "infrastructure": inputs.infrastructure,
            "places": inputs.places, "shaped_areas": inputs.shaped_areas,
            "turned_areas": lambda spark, sf_dir: inputs.shaped_areas(spark, sf_dir, TURN),
        }
        if name in stored:
            return stored[name](spark, self.sf_dir)
        if name == "countries":
            return _countries(spark, self.sf_dir)
        if name == "country_cover":
            return cover(stage("countries"))
        if name == "points_clean":
            points = inputs.gps_points(spark, self.sf_dir)
            return trajectory.drop_outlier_trips(points, hot=self.hot(spark))
        if name == "points_country":
            return pipeline.points_country(
                stage("points_clean"), stage("countries"), stage("country_cover")
            )
        if name == "points_mode":
            return pipeline.points_mode(stage("points_country"), self.hot(spark))
        if name == "trip_grain":
            return summary.trip_grain(stage("points_mode"))
        if name == "facet_cube":
            def keep(df: DataFrame, name: str) -> DataFrame:
                return write_stage(df, self.root, name)

            return cube.facet_cube(stage("trip_grain"), keep)
        if name == "trip_metrics":
            return segments.trip_metrics(stage("points_mode"), hot=self.hot(spark))
        if name == "route_responses":
            responses = inputs.route_responses(stage("points_clean"))
            return responses.withColumn("response", F.to_json("response"))
        if name == "hexagons":
            return inputs.hexagons(spark, self.sf_dir)
        if name == "travel_matrix":
            return inputs.travel_matrix(stage("hexagons"))
        raise KeyError(name)


def _countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = readers.read_divisions(spark, Stages.of(spark, sf_dir).stored(spark, "division_area"))
    return co.build_countries(areas, inputs.country_reference(spark, sf_dir))


def _infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_infrastructure(spark, Stages.of(spark, sf_dir).stored(spark, "infrastructure"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_places(spark, Stages.of(spark, sf_dir).stored(spark, "places"))


def _text(df: DataFrame) -> DataFrame:
    """Dates, times and lists as text, which every engine prints alike."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif kind == "array<int>":
            out[f.name] = F.concat(F.lit("["), F.array_join(F.col(f.name), ","), F.lit("]"))
        elif kind == "variant":
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Unrounded measures to six digits: the engines differ in the last bits of sine and cosine."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _text(build(prepare(spark), sf_dir))

    QUERIES[build.__name__] = run
    return build


def _stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Stages.of(spark, sf_dir).get(spark, name)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "points_mode")


def _hot(spark: SparkSession, sf_dir: str) -> trajectory.HotTrips:
    return Stages.of(spark, sf_dir).hot(spark)


# Points and trips.


@_query
def gps_points(spark, sf_dir):
    return inputs.gps_points(spark, sf_dir)


@_query
def speed_points(spark, sf_dir):
    speeds = trajectory.speed_points(inputs.gps_points(spark, sf_dir), hot=_hot(spark, sf_dir))
    return _rounded(
        speeds.select("uid", "tid", "event_id", "event_timestamp", "time_lag", "speed"), "speed"
    )


@_query
def outlier_trips(spark, sf_dir):
    return trajectory.outlier_trips(inputs.gps_points(spark, sf_dir), hot=_hot(spark, sf_dir))


@_query
def points_clean(spark, sf_dir):
    points = inputs.gps_points(spark, sf_dir)
    clean = trajectory.drop_outlier_trips(points, hot=_hot(spark, sf_dir))
    return _rounded(clean, "speed")


@_query
def country_reference_names(spark, sf_dir):
    """Customers per country of the full reference; an unknown code keeps NULL names."""
    customers = inputs.customer_codes(spark, sf_dir)
    named = join_lookup(customers, country_reference(spark), ["iso_code"], "left")
    return named.groupBy("iso_code", "english_name", "official_name").agg(
        F.count(F.lit(1)).alias("customers")
    )


QUERIES["country_reference"] = QUERIES.pop("country_reference_names")


@_query
def country_key_check(spark, sf_dir):
    """Codes are unique in the reference and not in the table that refers to it."""
    checked = {
        "reference": inputs.country_reference(spark, sf_dir).select("iso_code"),
        "customer": inputs.customer_codes(spark, sf_dir).select("iso_code"),
    }
    parts = [
        co.duplicate_keys(df, ["iso_code"]).select(
            F.lit(name).alias("checked"), "iso_code", "occurrences"
        )
        for name, df in checked.items()
    ]
    return parts[0].unionByName(parts[1])


@_query
def countries(spark, sf_dir):
    return _countries(spark, sf_dir).select(
        "id", "iso_code", "english_name", "official_name", "local_name", "subtype", "class",
        "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax",
        F.size(F.get("geometry", F.lit(0))).cast("long").alias("ring_points"),
    )


@_query
def points_country(spark, sf_dir):
    names = ("points_clean", "countries", "country_cover")
    tagged = pipeline.points_country(*(_stage(spark, sf_dir, s) for s in names))
    return _rounded(tagged, "speed")


@_query
def trip_statistics(spark, sf_dir):
    points = _stage(spark, sf_dir, "points_country")
    return trips.trip_statistics(points, _hot(spark, sf_dir))


@_query
def trip_modes(spark, sf_dir):
    return trips.trip_modes(_stage(spark, sf_dir, "points_country"), _hot(spark, sf_dir))


@_query
def points_mode(spark, sf_dir):
    points = _stage(spark, sf_dir, "points_country")
    return _rounded(pipeline.points_mode(points, _hot(spark, sf_dir)), "speed")


# Summaries.


def _grain(spark, sf_dir):
    return _stage(spark, sf_dir, "trip_grain")


@_query
def overview(spark, sf_dir):
    return summary.overview(_grain(spark, sf_dir))


@_query
def overview_filtered(spark, sf_dir):
    chosen = summary.facet_filter(
        _grain(spark, sf_dir), modes=FILTER_MODES, countries=FILTER_COUNTRIES
    )
    return summary.overview(chosen)


# The queries of the overview page under chosen facets: sets and sums from the cube, measures of
# single trips from the grain.


def _chosen(spark, sf_dir, name):
    return summary.facet_filter(
        _stage(spark, sf_dir, name), users=FILTER_USERS, modes=FILTER_MODES, countries=FILTER_COUNTRIES
    )


@_query
def chosen_overview(spark, sf_dir):
    return cube.overview(_chosen(spark, sf_dir, "facet_cube"))


@_query
def chosen_mode_distribution(spark, sf_dir):
    return cube.mode_distribution(_chosen(spark, sf_dir, "facet_cube"))


@_query
def chosen_top_countries(spark, sf_dir):
    return cube.top_countries(_chosen(spark, sf_dir, "facet_cube"))


@_query
def chosen_mode_by_country(spark, sf_dir):
    return cube.mode_by_country(_chosen(spark, sf_dir, "facet_cube"))


@_query
def chosen_speed_by_mode_country(spark, sf_dir):
    return cube.speed_by_mode_country(_chosen(spark, sf_dir, "facet_cube"), min_trips=1)


@_query
def chosen_speed_distribution(spark, sf_dir):
    return summary.speed_distribution(_chosen(spark, sf_dir, "trip_grain"))


@_query
def chosen_sample_trips(spark, sf_dir):
    return summary.sample_trips(_chosen(spark, sf_dir, "trip_grain"), n=20)


@_query
def cube_overview(spark, sf_dir):
    """The overview of everything from the cube: distinct trips and users without expanding rows."""
    return cube.overview(_stage(spark, sf_dir, "facet_cube"))


@_query
def facet_values(spark, sf_dir):
    grain = _grain(spark, sf_dir)
    parts = [
        summary.facet_values(grain, c).select(F.lit(c).alias("facet"), F.col(c).alias("value"))
        for c in ("uid", "transportation_mode", "country_name")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def mode_distribution(spark, sf_dir):
    return summary.mode_distribution(_grain(spark, sf_dir))


@_query
def top_countries(spark, sf_dir):
    return summary.top_countries(_grain(spark, sf_dir))


@_query
def speed_distribution(spark, sf_dir):
    return summary.speed_distribution(_grain(spark, sf_dir))


@_query
def mode_by_country(spark, sf_dir):
    return summary.mode_by_country(_grain(spark, sf_dir))


@_query
def mode_by_top_countries(spark, sf_dir):
    return summary.mode_by_top_countries(_grain(spark, sf_dir))


@_query
def speed_by_mode_country(spark, sf_dir):
    return summary.speed_by_mode_country(_grain(spark, sf_dir))


@_query
def sample_trips(spark, sf_dir):
    return summary.sample_trips(_grain(spark, sf_dir))


@_query
def trip_list(spark, sf_dir):
    return summary.trip_list(_grain(spark, sf_dir))


@_query
def trip_picker(spark, sf_dir):
    return summary.trips_for(summary.trip_list(_grain(spark, sf_dir)))


@_query
def trips_of_pair(spark, sf_dir):
    """The trips of one country and one mode, with their number."""
    return summary.trips_for(summary.trip_list(_grain(spark, sf_dir)), PAIR[0], PAIR[1])


# Segments and routes.


@_query
def one_trip_segments(spark, sf_dir):
    """The segments of one trip: the filter reaches the clustered points."""
    one = _points(spark, sf_dir).filter((F.col("uid") == ONE_TRIP[0]) & (F.col("tid") == ONE_TRIP[1]))
    return segments.trip_segments(one, hot=_hot(spark, sf_dir)).drop("segment_geojson")


@_query
def trip_segments(spark, sf_dir):
    out = segments.trip_segments(_points(spark, sf_dir), hot=_hot(spark, sf_dir))
    # The text of the line as numbers again: engines print the same number differently.
    shape = F.from_json("segment_geojson", "type string, coordinates array<array<double>>")
    out = out.withColumn("_line", shape).withColumns({
        "segment_type": F.col("_line.type"),
        "segment_lon1": F.col("_line.coordinates")[0][0],
        "segment_lat2": F.col("_line.coordinates")[1][1],
    })
    return out.drop("segment_geojson", "_line")


@_query
def trip_metrics(spark, sf_dir):
    return segments.trip_metrics(_points(spark, sf_dir), hot=_hot(spark, sf_dir))


@_query
def trip_endpoints(spark, sf_dir):
    return segments.trip_endpoints(segments.trip_segments(_points(spark, sf_dir), hot=_hot(spark, sf_dir)))


@_query
def trip_extent(spark, sf_dir):
    return segments.trip_extent(_stage(spark, sf_dir, "trip_metrics"))


@_query
def route_summary(spark, sf_dir):
    out = routes.route_summary(_responses(spark, sf_dir))
    return out.withColumn(
        "geometry_type", F.get_json_object("geometry_geojson", "$.type")
    ).drop("geometry_geojson")


def _responses(spark, sf_dir):
    return inputs.as_variants(_stage(spark, sf_dir, "route_responses"), "response")


@_query
def trip_profiles(spark, sf_dir):
    return routes.trip_profiles(summary.trip_list(_grain(spark, sf_dir)))


@_query
def route_comparison(spark, sf_dir):
    modes = _grain(spark, sf_dir).select("uid", "tid", "transportation_mode").distinct()
    profiles = routes.trip_profiles(modes).select("uid", "tid", "profile").distinct()
    actual = _stage(spark, sf_dir, "trip_metrics").join(profiles, ["uid", "tid"])
    return routes.route_comparison(actual, routes.route_summary(_responses(spark, sf_dir)))


# Places.


@_query
def infra_tags(spark, sf_dir):
    tags = pois.explode_tags(_infrastructure(spark, sf_dir))
    return tags.select("id", "class", "tag_key", "tag_value")


@_query
def hgv_parkings(spark, sf_dir):
    found = pois.hgv_parkings(
        _infrastructure(spark, sf_dir), _stage(spark, sf_dir, "countries"),
        grid=_stage(spark, sf_dir, "country_cover"),
    )
    corner = F.get("geometry", F.lit(0))
    return found.select(
        "id", "english_name",
        corner[0][0].alias("xmin"), corner[0][1].alias("ymin"),
        corner[2][0].alias("xmax"), corner[2][1].alias("ymax"),
    )


@_query
def retail_stores(spark, sf_dir):
    return pois.retail_stores(
        _places(spark, sf_dir), _stage(spark, sf_dir, "countries"), STORE_COUNTRY,
        grid=_stage(spark, sf_dir, "country_cover"),
    )


def _area_places(spark, sf_dir, name, turn):
    areas = readers.read_divisions(spark, Stages.of(spark, sf_dir).stored(spark, name))
    east = F.pmod(F.col("lng") + F.lit(turn + 180e0), F.lit(360e0)) - F.lit(180e0)
    places = _places(spark, sf_dir).select("id", east.alias("lng"), "lat")
    named = areas.select("id", "geometry", F.col("id").alias("area"))
    return join_intersects(places, named, "left").select("id", "area")


@_query
def area_places(spark, sf_dir):
    """Places in stored areas with holes and several parts."""
    return _area_places(spark, sf_dir, "shaped_areas", 0e0)


@_query
def date_line_places(spark, sf_dir):
    """The same areas and places, turned so that some areas lie over the date line."""
    return _area_places(spark, sf_dir, "turned_areas", TURN)


# Hexagons.


@_query
def origin_travel_times(spark, sf_dir):
    """Five rings around one origin, of a matrix that holds ten: one bucket is read."""
    matrix, cells = (_stage(spark, sf_dir, s) for s in ("travel_matrix", "hexagons"))
    return hx.travel_times(matrix, cells, k=5, origin=ORIGIN)


def _times(spark, sf_dir):
    return hx.travel_times(*(_stage(spark, sf_dir, s) for s in ("travel_matrix", "hexagons")))


@_query
def hex_disk(spark, sf_dir):
    return hx.hex_disk(_stage(spark, sf_dir, "hexagons"))


@_query
def travel_times(spark, sf_dir):
    return _times(spark, sf_dir)


@_query
def neighbour_detail(spark, sf_dir):
    return hx.neighbour_detail(_times(spark, sf_dir))


@_query
def neighbour_summary(spark, sf_dir):
    return hx.neighbour_summary(_times(spark, sf_dir))


@_query
def ring_stats(spark, sf_dir):
    return hx.ring_stats(_times(spark, sf_dir))
