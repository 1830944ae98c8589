"""Polygon tests and spatial joins, against a ray test in exact arithmetic."""

import math
import random
import uuid
from fractions import Fraction

import pytest
from frames import rows
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.operators.spatial_join import (
    cover,
    intersecting_pairs,
    join_intersects,
    join_polygons,
    join_within,
)

SHAPES = "id string, geometry array<array<array<double>>>"
SQUARE = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
HOLE = SQUARE + [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]
PARTS = SQUARE + [[[6.0, 0.0], [8.0, 0.0], [8.0, 2.0], [6.0, 2.0], [6.0, 0.0]]]


def edge_list(rings):
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else ring + ring[:1]
        for (x1, y1), (x2, y2) in zip(closed, closed[1:]):
            yield tuple(map(Fraction, (x1, y1, x2, y2)))


def locate(x, y, rings):
    """1 inside, 0 on the boundary, -1 outside."""
    x, y = Fraction(x), Fraction(y)
    inside = False
    for x1, y1, x2, y2 in edge_list(rings):
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return 1 if inside else -1


def edges_touch(a, b):
    ax, ay, bx, by = a
    cx, cy, dx, dy = b

    def turn(px, py, qx, qy, rx, ry):
        v = (qx - px) * (ry - py) - (rx - px) * (qy - py)
        return (v > 0) - (v < 0)

    if max(ax, bx) < min(cx, dx) or max(cx, dx) < min(ax, bx):
        return False
    if max(ay, by) < min(cy, dy) or max(cy, dy) < min(ay, by):
        return False
    return (
        turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0
        and turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0
    )


def meet(a, b):
    return (
        any(edges_touch(e, f) for e in edge_list(a) for f in edge_list(b))
        or any(locate(*ring[0], b) >= 0 for ring in a)
        or any(locate(*ring[0], a) >= 0 for ring in b)
    )


def star(r, cx, cy, radius, n):
    """A ring around a centre, whose edges do not cross."""
    angles = sorted(r.random() * 2 * math.pi for _ in range(n))
    ring = [[cx + radius * (0.3 + 0.7 * r.random()) * math.cos(a),
             cy + radius * (0.3 + 0.7 * r.random()) * math.sin(a)] for a in angles]
    return ring + ring[:1]


def shapes(seed, count=12):
    r = random.Random(seed)
    out = {"square": SQUARE, "hole": HOLE, "parts": PARTS}
    for i in range(count):
        size = r.choice([0.2, 1.0, 5.0])
        rings = [star(r, r.uniform(-6, 6), r.uniform(-6, 6), size, r.choice([3, 8, 40]))]
        if i % 3 == 0:
            rings.append(star(r, r.uniform(-6, 6), r.uniform(-6, 6), size, 5))
        out[f"s{i}"] = rings
    return out


def stored(spark, df, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_boundary_of_a_square(spark):
    cases = [(2.0, 2.0, 1), (0.0, 2.0, 0), (2.0, 4.0, 0), (0.0, 0.0, 0), (4.0, 4.0, 0),
             (5.0, 2.0, -1), (-1.0, 0.0, -1), (-1.0, 4.0, -1), (5.0, 4.0, -1)]
    df = spark.createDataFrame([(x, y, SQUARE) for x, y, _ in cases],
                               "x double, y double, g array<array<array<double>>>")
    got = df.select(
        "x", "y", geo.point_within(F.col("x"), F.col("y"), F.col("g"), geo.PLANE).alias("w"),
        geo.point_intersects(F.col("x"), F.col("y"), F.col("g"), geo.PLANE).alias("i"),
    ).collect()
    assert [(r.w, r.i) for r in got] == [(c == 1, c >= 0) for *_, c in cases]


@pytest.mark.parametrize(("leaf_edges", "max_level"), [(0, 7), (2, 14), (16, 14)])
def test_point_joins_equal_brute_force(spark, leaf_edges, max_level, tmp_path):
    r = random.Random(7)
    polys = shapes(1)
    # Random points, points of a lattice that hits cell borders, and corners of the polygons.
    pts = [(r.uniform(-8, 9), r.uniform(-8, 9)) for _ in range(300)]
    pts += [(float(x) / 2, float(y) / 2) for x in range(-4, 20, 2) for y in range(-4, 12)]
    pts += [tuple(p) for rings in polys.values() for ring in rings for p in ring]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)],
                                   "pid long, lng double, lat double")
    areas = spark.createDataFrame(list(polys.items()), SHAPES).withColumn("name", F.col("id"))
    grid = cover(areas, surface=geo.PLANE, leaf_edges=leaf_edges, max_level=max_level)
    grid = stored(spark, grid, tmp_path)
    where = {(i, n): locate(x, y, g) for i, (x, y) in enumerate(pts) for n, g in polys.items()}
    for join, least in ((join_within, 1), (join_intersects, 0)):
        got = rows(join(points, areas, "inner", grid=grid, surface=geo.PLANE), "pid", "name")
        assert got == sorted((k for k, v in where.items() if v >= least), key=repr)
    left = rows(join_within(points, areas, "left", grid=grid, surface=geo.PLANE), "pid", "name")
    alone = {i for i in range(len(pts))} - {i for (i, _), v in where.items() if v == 1}
    assert {p for p, n in left if n is None} == alone


def test_salted_join_equals_broadcast_join(spark, tmp_path):
    r = random.Random(9)
    # A third of the points share one cell.
    pts = [(i, *(2.1, 2.2)) if i % 3 == 0 else (i, r.uniform(-3, 9), r.uniform(-3, 9))
           for i in range(300)]
    points = spark.createDataFrame(pts, "pid long, lng double, lat double")
    areas = spark.createDataFrame(list(shapes(2).items()), SHAPES).withColumn("name", F.col("id"))
    grid = stored(spark, cover(areas), tmp_path)
    small = rows(join_within(points, areas, grid=grid))
    assert rows(join_within(points, areas, grid=grid, limit=0)) == small
    assert len(small) >= 300


@pytest.mark.parametrize(("left_leaf", "right_leaf"), [(16, 16), (1, 4), (4, 0)])
def test_polygon_pairs_equal_brute_force(spark, left_leaf, right_leaf, tmp_path):
    polys = shapes(4, 14)
    polys["cross"] = [[[-1.0, 1.8], [9.0, 1.8], [9.0, 2.2], [-1.0, 2.2], [-1.0, 1.8]]]
    polys["in_hole"] = [[[1.5, 1.5], [2.5, 1.5], [2.5, 2.5], [1.5, 2.5], [1.5, 1.5]]]
    polys["corner"] = [[[4.0, 4.0], [5.0, 4.0], [5.0, 5.0], [4.0, 4.0]]]
    polys["apart"] = [[[4.0, 6.0], [5.0, 6.0], [5.0, 7.0], [4.0, 6.0]]]
    polys["around"] = [[[-9.0, -9.0], [9.5, -9.0], [9.5, 9.0], [-9.0, 9.0], [-9.0, -9.0]]]
    df = spark.createDataFrame(list(polys.items()), SHAPES)
    want = sorted((a, b) for a in polys for b in polys if meet(polys[a], polys[b]))
    left, right = (
        stored(spark, cover(df, surface=geo.PLANE, leaf_edges=n, max_level=8), tmp_path)
        for n in (left_leaf, right_leaf)
    )
    assert rows(intersecting_pairs(df, df, left_grid=left, right_grid=right)) == want
    direct = df.alias("a").join(
        df.alias("b"), geo.polygons_intersect(F.col("a.geometry"), F.col("b.geometry"), geo.PLANE)
    ).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"))
    assert rows(direct) == want


def test_pair_over_many_cells_is_one_row(spark):
    big = [("p", [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]]])]
    left = spark.createDataFrame(big, SHAPES)
    right = left.withColumn("name", F.lit("x"))
    assert rows(join_polygons(left, right), "id", "name") == [("p", "x")]


def test_missing_position_stays_in_a_left_join(spark):
    odd = [None, math.nan, math.inf, -math.inf]
    places = [(2, 2.0, 2.0)] + [(10 + i, x, 2.2) for i, x in enumerate(odd)] + [(20 + i, 2.2, y) for i, y in enumerate([*odd, 91.0])]
    points = spark.createDataFrame(places, "pid long, lng double, lat double")
    areas = spark.createDataFrame([("square", SQUARE)], SHAPES).withColumn("name", F.col("id"))
    want = sorted([(p, "square" if p == 2 else None) for p, _, _ in places], key=repr)
    assert rows(join_within(points, areas), "pid", "name") == want
    assert rows(join_intersects(points, areas), "pid", "name") == [(2, "square")]
