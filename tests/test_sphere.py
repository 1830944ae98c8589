"""Great-circle edges, the date line, poles, stored geometries and the quad-tree cover.

The brute force knows no great circles: it walks each edge in many small steps, takes the walk as
a ring in the plane, longitudes carried on over the date line, and tests points on that.
"""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from frames import rows
from pyspark.sql import functions as F

from tripweave.functions import geo, quadtree
from tripweave.operators import spatial_join
from tripweave.operators.spatial_join import cover, intersecting_pairs, join_within
from tripweave.sources import readers

SHAPES = "id string, geometry array<array<array<double>>>"
STEPS = 400


def unit(p):
    lng, lat = map(math.radians, p)
    return np.array([math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat)])


def walked(ring):
    """The ring in small steps of its arcs, as an unbroken line of longitudes and latitudes."""
    closed = ring if ring[0] == ring[-1] else ring + ring[:1]
    out = [tuple(closed[0])]
    for p, q in zip(closed, closed[1:]):
        a, b = unit(p), unit(q)
        angle = math.acos(max(-1.0, min(1.0, float(a @ b))))
        for k in range(1, STEPS + 1):
            t = k / STEPS
            v = (math.sin((1 - t) * angle) * a + math.sin(t * angle) * b) / math.sin(angle) if angle > 0 else a
            lng = math.degrees(math.atan2(v[1], v[0]))
            lng += 360 * round((out[-1][0] - lng) / 360)
            out.append((lng, math.degrees(math.asin(max(-1.0, min(1.0, v[2]))))))
    return np.array(out)


def located(lng, lat, lines):
    """1 inside, -1 outside, 0 too near to the boundary to tell; ``lines`` are walked rings."""
    inside = False
    for walk in lines:
        for turn in (-360, 0, 360):
            line = walk + np.array([turn, 0.0])
            x1, y1, x2, y2 = line[:-1, 0], line[:-1, 1], line[1:, 0], line[1:, 1]
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((lng - x1) * dx + (lat - y1) * dy) / np.maximum(dx * dx + dy * dy, 1e-30), 0, 1)
            if np.min(np.hypot(x1 + t * dx - lng, y1 + t * dy - lat)) < 2e-3:
                return 0
            span = (y1 > lat) != (y2 > lat)
            cut = x1[span] + (lat - y1[span]) * dx[span] / dy[span]
            inside ^= bool((cut > lng).sum() % 2)
    return 1 if inside else -1


def turned(ring, by):
    return [[(x + by + 180) % 360 - 180, y] for x, y in ring]


LONG = [[-60.0, 40.0], [70.0, 45.0], [60.0, -10.0], [-50.0, 5.0], [-60.0, 40.0]]
NORTH = [[-30.0, 62.0], [35.0, 60.0], [20.0, 78.0], [-30.0, 62.0]]
HOLE = [[0.0, 20.0], [20.0, 20.0], [20.0, 30.0], [0.0, 30.0], [0.0, 20.0]]
POLYGONS = {
    "long": [LONG], "north": [NORTH], "holed": [LONG, HOLE], "holed_back": [LONG[::-1], HOLE],
    "parts": [NORTH, [[-20.0, -20.0], [15.0, -25.0], [0.0, -40.0], [-20.0, -20.0]]],
    "over_line": [turned(LONG, 170)], "over_line_holed": [turned(LONG, 170), turned(HOLE, 170)],
    "on_line": [[[180.0, 10.0], [-170.0, 12.0], [-172.0, -5.0], [180.0, -3.0], [180.0, 10.0]]],
}


def spots(seed, n):
    r = random.Random(seed)
    return [(r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-0.99, 0.99)))) for _ in range(n)]


@pytest.mark.parametrize("leaf_edges", [1, 16])
def test_points_in_long_edges_and_over_the_date_line(spark, leaf_edges, tmp_path):
    near = [(float(x + dx), y + dy) for x, y in [(5, 43.7), (0, 60.9), (175, 44), (-175, 20)]
            for dx in (-20, -3, 4, 15) for dy in (-1.5, -0.4, 0.6, 2.0)]
    places = spots(3, 250) + near
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "pid long, lng double, lat double")
    areas = spark.createDataFrame(list(POLYGONS.items()), SHAPES).withColumn("name", F.col("id"))
    cover(areas, leaf_edges=leaf_edges, max_level=8).write.parquet(f"{tmp_path}/grid")
    grid = spark.read.parquet(f"{tmp_path}/grid")
    got = set(rows(join_within(points, areas, "inner", grid=grid), "pid", "name"))
    walks = {n: [walked(ring) for ring in rings] for n, rings in POLYGONS.items()}
    truth = {(i, n): located(x, y, lines) for i, (x, y) in enumerate(places) for n, lines in walks.items()}
    assert {k for k, v in truth.items() if v == 1} <= got
    assert not got & {k for k, v in truth.items() if v == -1}
    assert len(got) > 150 and sum(v == 0 for v in truth.values()) < 40
    direct = points.where("lng >= -180 AND lng < 180").crossJoin(areas).where(geo.point_within(F.col("lng"), F.col("lat"), F.col("geometry")))
    beyond = {i for i, (x, _) in enumerate(places) if not -180 <= x < 180}
    assert set(rows(direct, "pid", "name")) == {(p, n) for p, n in got if p not in beyond}


def test_edges_of_the_sphere_are_not_those_of_the_plane(spark):
    """The arc from 60 W to 70 E at forty degrees north passes far north of the straight line."""
    points = spark.createDataFrame([(1, 5.0, 55.0)], "pid long, lng double, lat double")
    areas = spark.createDataFrame([("long", [LONG])], SHAPES).withColumn("name", F.col("id"))
    assert rows(join_within(points, areas, "inner"), "name") == [("long",)]
    assert join_within(points, areas, "inner", surface=geo.PLANE).count() == 0


def test_rings_around_a_pole(spark):
    cap = [[-120.0, 60.0], [0.0, 60.0], [120.0, 60.0], [-120.0, 60.0]]
    cut = [[-180.0, 65.0], [-60.0, 65.0], [60.0, 65.0], [180.0, 65.0], [180.0, 90.0], [-180.0, 90.0], [-180.0, 65.0]]
    south = [[x, -y] for x, y in cap]
    areas = spark.createDataFrame([("cap", [cap]), ("cut", [cut]), ("south", [south])], SHAPES).withColumn("name", F.col("id"))
    places = [(0, 90.0, 89.0), (1, -179.0, 85.0), (2, 10.0, 50.0), (3, 10.0, -85.0), (4, 179.9, 88.0), (5, 10.0, 0.0)]
    points = spark.createDataFrame(places, "pid long, lng double, lat double")
    got = set(rows(join_within(points, areas, "inner"), "pid", "name"))
    assert got == {(p, n) for p in (0, 1, 4) for n in ("cap", "cut")} | {(3, "south")}


def test_polygons_meet_over_the_date_line(spark):
    boxes = {
        "over": [[[178.0, 1.0], [-178.0, 1.0], [-178.0, 3.0], [178.0, 3.0], [178.0, 1.0]]],
        "west": [[[176.0, 2.0], [179.0, 2.0], [179.0, 4.0], [176.0, 4.0], [176.0, 2.0]]],
        "east": [[[-179.5, 0.0], [-176.0, 0.0], [-176.0, 2.0], [-179.5, 2.0], [-179.5, 0.0]]],
        "inside": [[[-179.9, 1.5], [-179.8, 1.5], [-179.8, 1.6], [-179.9, 1.5]]],
        "far": [[[10.0, 1.0], [12.0, 1.0], [12.0, 3.0], [10.0, 3.0], [10.0, 1.0]]],
        "wide": [LONG],
    }
    df = spark.createDataFrame(list(boxes.items()), SHAPES)
    got = set(rows(intersecting_pairs(df, df)))
    want = {("over", "west"), ("over", "east"), ("over", "inside"), ("far", "wide")}
    assert got == want | {(b, a) for a, b in want} | {(n, n) for n in boxes}


def test_a_country_in_few_cells():
    """The cells of a ragged border against squares of the smallest side, with equal results."""
    r = random.Random(2)
    ring = []
    for k in range(3000):
        a, radius = 2 * math.pi * k / 3000, 4 + 0.5 * math.sin(40 * k / 3000) + r.uniform(0, 0.02)
        ring.append([10 + radius * math.cos(a), 48 + radius * math.sin(a)])
    shape = quadtree.Polygon([ring], geo.SPHERE)
    cells = shape.cells(16, 14)
    finest = max(c[0] for c in cells)
    area = sum(4.0 ** (finest - c[0]) for c in cells)
    assert len(cells) < area / 10
    assert all(len(c[4]) <= 16 for c in cells)
    by_cell = {(c[0], c[1], c[2]): c for c in cells}
    for _ in range(400):
        x, y = r.uniform(4, 16), r.uniform(42, 54)
        mine = None
        for level in range(15):
            size = quadtree.BASE_DEGREES / 2**level
            mine = mine or by_cell.get((level, math.floor(x / size), math.floor(y / size)))
        inside = False
        if mine:
            level, ci, cj, inside, local = mine
            size = quadtree.BASE_DEGREES / 2**level
            cx, cy = (ci + quadtree.CENTRE_X) * size, (cj + quadtree.CENTRE_Y) * size
            inside ^= bool((shape.above(local, x, y, cy) != shape.above(local, cx, cy, cy)).sum() % 2)
        assert inside == shape.inside(x, y)


def test_cover_in_arrays_equals_the_columns(spark):
    """The edges of a cover are those of the column functions."""
    df = spark.createDataFrame(list(POLYGONS.items()), SHAPES)
    for row in df.select("id", "geometry", geo.edges(F.col("geometry")).alias("e")).collect():
        made = quadtree.pieces(row.geometry, geo.SPHERE)
        for name in quadtree.FIELDS:
            assert np.allclose([float(e[name]) for e in row.e], made[name].astype(float), atol=1e-12), (row.id, name)


def test_stored_geometries(spark, tmp_path):
    texts = {
        "polygon": json.dumps({"type": "Polygon", "coordinates": [LONG, HOLE]}),
        "multi": json.dumps({"type": "MultiPolygon", "coordinates": [[LONG, HOLE], [NORTH]]}),
        "high": json.dumps({"type": "Polygon", "coordinates": [[[*p, 7.5] for p in HOLE]]}),
        "point": '{"type":"Point","coordinates":[1.5,2.5]}', "damaged": '{"type":"Polygon","coordinates":[[',
        "odd": '{"type":"Polygon","coordinates":[[[0,0],[1,null],[1,1]]]}', "empty": "", "none": None,
        "short": '{"type":"Polygon","coordinates":[[[0,0],[1,1]]]}', "south": '{"type":"Polygon","coordinates":[[[0,0],[1,-91],[1,1]]]}',
    }
    df = spark.createDataFrame(list(texts.items()), "id string, geometry string").selectExpr(
        "id", "'parking' AS class", "'transit' AS subtype", "geometry", "'{}' AS source_tags", "1 AS more"
    )
    df.write.parquet(f"{tmp_path}/infrastructure")
    got = {r.id: (r.geom_type, r.geometry) for r in readers.read_infrastructure(spark, f"{tmp_path}/infrastructure").collect()}
    assert got["polygon"] == ("Polygon", [LONG, HOLE]) and got["multi"] == ("MultiPolygon", [LONG, HOLE, NORTH])
    assert got["high"][1][0][0][:2] == HOLE[0] and got["point"] == ("Point", None)
    assert all(got[n][1] is None for n in ("damaged", "odd", "empty", "none", "short", "south"))
    areas = readers.read_infrastructure(spark, f"{tmp_path}/infrastructure").select("id", "geometry", F.col("id").alias("name"))
    points = spark.createDataFrame([(1, 10.0, 25.0), (2, 0.5, 70.0), (3, 5.0, 10.0)], "pid long, lng double, lat double")
    assert rows(join_within(points, areas, "inner"), "pid", "name") == [
        (1, "high"), (2, "multi"), (3, "multi"), (3, "polygon"),
    ]


def test_stored_points_and_rows_without_an_event_id(spark, tmp_path):
    places = [("p1", '{"type":"Point","coordinates":[1.5,2.5]}'), ("p2", None), ("p3", '{"type":"Polygon","coordinates":[]}')]
    spark.createDataFrame(places, "id string, geometry string").selectExpr(
        "id", "geometry", "'{}' AS names", "'{}' AS categories", "'[]' AS addresses"
    ).write.parquet(f"{tmp_path}/places")
    got = {r.id: (r.lng, r.lat) for r in readers.read_places(spark, f"{tmp_path}/places").collect()}
    assert got == {"p1": (1.5, 2.5), "p2": (None, None), "p3": (None, None)}
    raw = spark.range(6).selectExpr(
        "'u' AS UID", "'t' AS TID", "10e0 + id / 1e4 AS LAT", "1e0 AS LNG", "0 AS ZERO_COL", "0e0 AS ALT", "0e0 AS DAYNO",
        "date'2024-01-01' AS EVENT_DATE", "'00:00:00' AS EVENT_TIME", "timestamp'2024-01-01 00:00:00' AS EVENT_TIMESTAMP",
        "'x' AS GEOMETRY",
    )
    raw.union(raw.limit(1)).write.parquet(f"{tmp_path}/points")
    first = readers.read_points(spark, f"{tmp_path}/points")
    assert first.select("event_id").distinct().count() == 6 and first.count() == 7
    assert rows(first) == rows(readers.read_points(spark, f"{tmp_path}/points"))


def test_many_polygons_are_cut_together(monkeypatch):
    """The steps of Python do not grow with the polygons, and the cells are those of each alone."""
    r, calls = random.Random(4), []
    plain = quadtree._vectors
    monkeypatch.setattr(quadtree, "_vectors", lambda *a: calls.append(1) or plain(*a))

    def box():
        x, y, h = r.uniform(-170, 170), r.uniform(-80, 80), r.choice([0.01, 0.2, 3])
        return [[[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]]

    rings = pa.list_(pa.list_(pa.list_(pa.float64())))

    def batch(shapes):
        return pa.record_batch([pa.array(range(len(shapes))), pa.array(shapes, rings)], ["id", "geometry"])

    def made(shapes):
        calls.clear()
        out = {}
        for ids, rings in spatial_join._portions(batch(shapes)):
            polygons = quadtree.Polygons(*spatial_join._ring_points(rings), geo.SPHERE)
            for row in spatial_join._cell_rows(ids, polygons, polygons.cells(2, 9)).to_pylist():
                id_ = row.pop("id")
                edges = row.pop("edges")
                out.setdefault(id_, []).append((*row.values(), None if edges is None else [list(e.values()) for e in edges]))
        return {k: sorted(v, key=repr) for k, v in out.items()}, len(calls)

    few = [box() for _ in range(40)]
    many = few + [box() for _ in range(960)]
    alone = [made([shape])[0][0] for shape in few]
    _, steps = made(few)
    cells, more_steps = made(many)
    assert more_steps <= 2 * steps and [cells[i] for i in range(40)] == alone and len(cells) == 1000
    # Nulls and polygons without a point have no cell; a portion is one polygon or a bounded number of points.
    monkeypatch.setattr(spatial_join, "POINTS_AT_ONCE", 12)
    odd = [None, few[0], [], [[]], few[1], few[2], few[0] * 5, None, few[3]]
    portions = [ids.to_pylist() for ids, _ in spatial_join._portions(batch(odd))]
    assert portions == [[0, 1, 2, 3, 4], [5], [6], [7, 8]]
    assert set(made([None, *few, []])[0]) == set(range(1, 41))
