"""Spatial joins by a quad tree of cells.

Polygons are turned into a *cover*: one row per polygon and cell. Cells come in levels, each level
halves the side of the one before; a cell is cut into its four quarters while it holds more than a
few edges, so the inside of a country is a few large cells and only its border has small ones.
Rows carry their level, so a cover says itself how large its cells are. A cell that no edge
touches lies wholly inside and needs no test. A cell on the boundary carries the edges that touch
it, and whether one fixed point of it, its centre, is inside: found from the centre of the cell it
was cut from by the edges on the way, so one rule decides for polygons of any size. A point is
inside when the side of the centre changes an even number of times on the way to it, so a test
costs the edges of one cell and not those of a country.

Points are joined level by level. All rows of a cell are one list, and each join adds at most one
list to a point, so points are never multiplied before the test, and a polygon has each place
once: point joins need no duplicate removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, quadtree
from ..session import ship
from .joins import join_lookup, measured_bytes

#: The last level: cells of five thousandths of a degree.
MAX_LEVEL = 14
#: Cells with more edges than this are cut, up to the last level.
LEAF_EDGES = 16
#: Points of the polygons that are covered in one step.
POINTS_AT_ONCE = 1 << 15
# A cover is broadcast up to this measured size: larger than other tables, because the
# alternative shuffles all points. It grows with the polygons, not with the points.
COVER_BROADCAST_BYTES = 512 * 1024 * 1024


def side_of(level: Column | int) -> Column:
    """Degrees of a cell's side; exact, as all sides are powers of two."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.lit(quadtree.BASE_DEGREES) / F.pow(F.lit(2e0), level.cast("double"))


def cell_of(x: Column, y: Column, level: Column | int) -> tuple[Column, Column]:
    """The cell of a position; the last longitude and latitude belong to the last cells."""
    most = F.lit(quadtree.BASE_DEGREES) / side_of(level)
    return tuple(
        F.least(F.floor(v / side_of(level)), most * cells - 1).cast("long") for v, cells in ((x, 2), (y, 1))
    )


def _centre(level: Column, ci: Column, cj: Column) -> tuple[Column, Column]:
    side = side_of(level)
    return (ci + F.lit(quadtree.CENTRE_X)) * side, (cj + F.lit(quadtree.CENTRE_Y)) * side


def _in_cell(e: Column, level: Column, ci: Column, cj: Column) -> Column:
    side = side_of(level)
    return geo.edge_meets_box(e, ci * side, cj * side, (ci + 1) * side, (cj + 1) * side)


EDGE = (
    "struct<ax:double,ay:double,xl:double,yl:double,xr:double,yr:double,first:boolean,"
    "nx:double,ny:double,nz:double,past:boolean>"
)


def cover(
    polygons: DataFrame,
    *,
    id_column: str = "id",
    geometry: str = "geometry",
    surface: str = geo.SPHERE,
    leaf_edges: int = LEAF_EDGES,
    max_level: int = MAX_LEVEL,
) -> DataFrame:
    """``(id, level, ci, cj, cy, centre_in, edges)``; ``edges`` is NULL in cells wholly inside.

    ``cy`` is the latitude of the cell's centre; an edge has besides its fields ``past``, on which
    side it passes the centre. Polygon ids must be unique. Longitudes are cut at the date line.
    Cells are cut where the polygons are, in Arrow batches, those of many polygons together: cutting
    recurses, which no expression does. Nothing is shuffled.
    """
    ship(polygons.sparkSession)
    shapes = polygons.select(F.col(id_column).alias("id"), F.col(geometry).alias("geometry"))
    kind = shapes.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, level int, ci long, cj long, cy double, centre_in boolean, edges array<{EDGE}>"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rings in _portions(batch):
                shapes = quadtree.Polygons(*_ring_points(rings), surface)
                cells = shapes.cells(leaf_edges, max_level)
                if cells is not None:
                    yield _cell_rows(ids, shapes, cells)

    return shapes.mapInArrow(cut, schema)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and rings of about ``POINTS_AT_ONCE`` points, or of one polygon that has more."""
    ids, rings = batch.column(0), batch.column(1)
    rings_of = np.cumsum(np.append(0, _lengths(rings)))
    points = np.cumsum(np.append(0, _lengths(rings.flatten())))[rings_of]
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(points, points[at] + POINTS_AT_ONCE, "right")) - 1)
        yield ids.slice(at, to - at), rings.slice(at, to - at)
        at = to


def _ring_points(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longitudes and latitudes of all points, points of each ring, rings of each polygon."""
    rings = polygons.flatten()
    points = rings.flatten()
    numbers = _lengths(points)
    if (numbers < 2).any():
        raise ValueError("a ring has a point without longitude and latitude")
    values = points.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(numbers) - numbers
    return values[at], values[at + 1], _lengths(rings), _lengths(polygons)


def _cell_rows(ids: pa.Array, shapes: quadtree.Polygons, cells: quadtree.Cells) -> pa.RecordBatch:
    cx, cy = cells.centres()
    here = cells.of_edge
    past = shapes.above(cells.edges, cx[here], cy[here], cy[here])
    fields = []
    for name in quadtree.FIELDS:
        values = shapes.edges[name][cells.edges]
        none = np.isnan(values) if name in ("nx", "ny", "nz") else None
        fields.append(pa.array(values, mask=none))
    fields.append(pa.array(past.astype(bool)))
    flat = pa.StructArray.from_arrays(fields, [*quadtree.FIELDS, "past"])
    # A list without edges is NULL: such a cell lies wholly inside.
    offsets = np.append(0, np.cumsum(cells.counts))
    offsets = pa.array(offsets, pa.int32(), mask=np.append(cells.counts == 0, False))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(cells.polygon)), pa.array(cells.level, pa.int32()), pa.array(cells.ci, pa.int64()),
            pa.array(cells.cj, pa.int64()), pa.array(cy), pa.array(cells.centre_in, pa.bool_()),
            pa.ListArray.from_arrays(offsets, flat),
        ],
        ["id", "level", "ci", "cj", "cy", "centre_in", "edges"],
    )


def _turned(edges: Column, x: Column, y: Column, cy: Column) -> Column:
    """The side changes on the way from the point to the centre of the edges' cell."""
    return geo.odd(F.filter(edges, lambda e: geo.above(e, x, y, cy) != e["past"]))


def _inside(cell: Column, lng: Column, lat: Column, closed: bool) -> Column:
    """Point test against one row of the cover, whose cell the point is in."""
    inside = cell["centre_in"] != _turned(cell["edges"], lng, lat, cell["cy"])
    on_edge = geo.on_edges(cell["edges"], lng, lat)
    exact = (inside | on_edge) if closed else (inside & ~on_edge)
    return F.when(cell["edges"].isNull(), F.lit(True)).otherwise(exact)


def levels_of(grid: DataFrame) -> list[int]:
    """The levels a cover has, at most ``MAX_LEVEL`` + 1."""
    return sorted(r["level"] for r in grid.select("level").distinct().collect())


def _join_points(
    points: DataFrame,
    polygons: DataFrame,
    how: str,
    closed: bool,
    lng: str,
    lat: str,
    id_column: str,
    geometry: str,
    grid: DataFrame | None,
    surface: str,
    limit: int,
) -> DataFrame:
    values = [c for c in polygons.columns if c not in (geometry, id_column)]
    if grid is None:
        grid = cover(polygons, id_column=id_column, geometry=geometry, surface=surface)
    named = polygons.select(
        F.col(id_column).alias("id"), F.struct(F.lit(True).alias("_here"), *values).alias("values")
    )
    grid = grid.join(named, "id").select(
        "level", "ci", "cj", F.struct("cy", "centre_in", "edges", "values").alias("_cell")
    )
    small = measured_bytes(grid) <= limit
    # What is no position is in no cell. Longitudes beyond the date line are the same places on
    # the sphere, and nowhere on the plane.
    turn = F.pmod(F.col(lng) + F.lit(180e0), F.lit(360e0)) - F.lit(180e0)
    within = F.col(lng).between(-180, 180) & (F.col(lng) < 180)
    x = F.when(within, F.col(lng)).otherwise(turn) if surface == geo.SPHERE else F.col(lng)
    real = geo.is_position(F.col(lng), F.col(lat))
    real = real if surface == geo.SPHERE else real & F.col(lng).between(-180, 180)
    joined = points.withColumns({"_x": F.when(real, x), "_y": F.when(real, F.col(lat))})
    found = []
    for level in levels_of(grid):
        lists = grid.where(F.col("level") == level).groupBy(F.col("ci").alias("_ci"), F.col("cj").alias("_cj"))
        lists = lists.agg(F.collect_list("_cell").alias(f"_cells_{level}"))
        joined = joined.withColumns(dict(zip(("_ci", "_cj"), cell_of(F.col("_x"), F.col("_y"), level))))
        joined = join_lookup(joined, lists, ["_ci", "_cj"], "left", small=small)
        found.append(F.coalesce(F.col(f"_cells_{level}"), F.array()))
    kept = [*points.columns]
    if not found:
        empty = [F.lit(None).cast(polygons.schema[c].dataType).alias(c) for c in values]
        return joined.select(*kept, *empty).where(F.lit(how == "left"))
    hits = F.filter(F.concat(*found), lambda c: _inside(c, F.col("_x"), F.col("_y"), closed))
    unfold = F.explode_outer if how == "left" else F.explode
    rows = joined.select(*kept, unfold(F.transform(hits, lambda c: c["values"])).alias("_hit"))
    return rows.select(*kept, *[F.col(f"_hit.{c}").alias(c) for c in values])


def join_within(
    points: DataFrame,
    polygons: DataFrame,
    how: str = "left",
    *,
    lng: str = "lng",
    lat: str = "lat",
    id_column: str = "id",
    geometry: str = "geometry",
    grid: DataFrame | None = None,
    surface: str = geo.SPHERE,
    limit: int = COVER_BROADCAST_BYTES,
) -> DataFrame:
    """Join points to the polygons they lie strictly within.

    The columns of ``polygons`` other than id and geometry are added. A point within several
    polygons gives a row for each; with ``how="left"`` one in none gives a row with NULLs, and
    so does one whose position is NULL or not finite. ``grid`` is a stored :func:`cover` that
    holds at least these polygons.
    """
    return _join_points(
        points, polygons, how, False, lng, lat, id_column, geometry, grid, surface, limit
    )


def join_intersects(
    points: DataFrame,
    polygons: DataFrame,
    how: str = "inner",
    *,
    lng: str = "lng",
    lat: str = "lat",
    id_column: str = "id",
    geometry: str = "geometry",
    grid: DataFrame | None = None,
    surface: str = geo.SPHERE,
    limit: int = COVER_BROADCAST_BYTES,
) -> DataFrame:
    """As :func:`join_within`, the boundary included."""
    return _join_points(
        points, polygons, how, True, lng, lat, id_column, geometry, grid, surface, limit
    )


def _with_ancestors(grid: DataFrame, from_level: int, own: bool) -> DataFrame:
    """Each row once for every cell it lies in, from a level on; its own cell only if ``own``."""
    last = F.col("level") if own else F.col("level") - 1
    ups = F.when(last >= from_level, F.sequence(F.lit(from_level), last.cast("int"))).otherwise(F.array())
    step = F.col("level") - F.col("_level")
    return grid.withColumn("_level", F.explode(ups)).withColumns({
        "_ci": F.floor(F.col("ci") / F.pow(F.lit(2e0), step)).cast("long"),
        "_cj": F.floor(F.col("cj") / F.pow(F.lit(2e0), step)).cast("long"),
    })


def _meet(s: str, b: str) -> Column:
    """Whether two polygons meet in the cell ``s``, which lies in or is the cell ``b``.

    Both are looked at in the smaller cell: the larger one's edges are cut to those that reach
    it, and its side is carried to the centre of the smaller one.
    """
    level, ci, cj = (F.col(f"{s}{c}") for c in ("level", "ci", "cj"))
    x, y = _centre(level, ci, cj)
    mine, theirs = F.col(f"{s}edges"), F.col(f"{b}edges")
    local = F.filter(F.coalesce(theirs, F.array()), lambda e: _in_cell(e, level, ci, cj))
    all_theirs = F.coalesce(theirs, F.array())
    centre_in = F.col(f"{b}centre_in") != _turned(all_theirs, x, y, F.col(f"{b}cy"))

    def starts_in_mine(start: Column) -> Column:
        px, py = start["ax"], start["ay"]
        at_i, at_j = cell_of(px, py, level)
        here = (at_i == ci) & (at_j == cj)
        inside = F.col(f"{s}centre_in") != _turned(mine, px, py, F.col(f"{s}cy"))
        return start["first"] & here & inside

    def starts_in_theirs(start: Column) -> Column:
        px, py = start["ax"], start["ay"]
        at_i, at_j = cell_of(px, py, level)
        here = (at_i == ci) & (at_j == cj)
        inside = F.col(f"{b}centre_in") != _turned(all_theirs, px, py, F.col(f"{b}cy"))
        return start["first"] & here & inside

    both = (
        geo.edge_lists_meet(mine, theirs) | F.exists(theirs, starts_in_mine) | F.exists(mine, starts_in_theirs)
    )
    return (
        F.when(theirs.isNull(), F.lit(True))
        .when(mine.isNull(), (F.size(local) > 0) | centre_in)
        .when(F.size(local) == 0, centre_in)
        .otherwise(both)
    )


def intersecting_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    id_column: str = "id",
    geometry: str = "geometry",
    right_grid: DataFrame | None = None,
    left_grid: DataFrame | None = None,
    surface: str = geo.SPHERE,
    limit: int = COVER_BROADCAST_BYTES,
) -> DataFrame:
    """Distinct ``(left_id, right_id)`` of polygons that share a point.

    Both sides are covered. Cells share space when one is the other or holds it, so the smaller
    one is joined by the cells that it lies in. There they meet if one of them fills what they
    share, if edges meet, or if a ring point of one lies in the other; some shared cell shows it.
    """
    names = {"id_column": id_column, "geometry": geometry, "surface": surface}
    left_grid = cover(left, **names) if left_grid is None else left_grid
    right_grid = cover(right, **names) if right_grid is None else right_grid
    fields = ("level", "ci", "cj", "cy", "centre_in", "edges")

    def named(grid: DataFrame, prefix: str, keys: tuple[str, str, str]) -> DataFrame:
        return grid.select(
            F.col("id").alias(f"{prefix}id"), *[F.col(f).alias(f"{prefix}{f}") for f in fields],
            *[F.col(k).alias(n) for k, n in zip(keys, ("_level", "_ci", "_cj"))],
        )

    own, up = ("level", "ci", "cj"), ("_level", "_ci", "_cj")
    left_levels, right_levels = levels_of(left_grid), levels_of(right_grid)
    if not left_levels or not right_levels:
        ids = left.select(F.col(id_column).alias("left_id")), right.select(F.col(id_column).alias("right_id"))
        return ids[0].join(ids[1], F.lit(False), "inner")
    # The left cell is the smaller one or the same, then the right one is smaller.
    smaller = named(_with_ancestors(left_grid, right_levels[0], True), "_a_", up)
    larger = named(right_grid, "_b_", own)
    hits = join_lookup(
        smaller, larger, ["_level", "_ci", "_cj"], "inner", condition=_meet("_a_", "_b_"),
        salt_by=["_a_id"], limit=limit,
    ).select(F.col("_a_id").alias("left_id"), F.col("_b_id").alias("right_id"))
    larger = named(left_grid, "_a_", own)
    smaller = named(_with_ancestors(right_grid, left_levels[0], False), "_b_", up)
    more = join_lookup(
        larger, smaller, ["_level", "_ci", "_cj"], "inner", condition=_meet("_b_", "_a_"),
        salt_by=["_a_id"], limit=limit,
    ).select(F.col("_a_id").alias("left_id"), F.col("_b_id").alias("right_id"))
    return hits.union(more).distinct()


def join_polygons(
    left: DataFrame,
    right: DataFrame,
    *,
    id_column: str = "id",
    geometry: str = "geometry",
    right_grid: DataFrame | None = None,
    surface: str = geo.SPHERE,
    limit: int = COVER_BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of polygons to the polygons they intersect, one row per pair.

    Adds the columns of ``right`` other than id and geometry to those of ``left``.
    ``right_grid`` is a stored :func:`cover` that holds at least the polygons of ``right``. Rows
    of ``left`` that repeat an id stand for one polygon; each of them gets the pairs of its id.
    """
    pairs = intersecting_pairs(
        left.dropDuplicates([id_column]), right, id_column=id_column, geometry=geometry, right_grid=right_grid,
        surface=surface, limit=limit,
    )
    values = [c for c in right.columns if c not in (id_column, geometry)]
    named = right.select(F.col(id_column).alias("right_id"), *values)
    pairs = join_lookup(pairs, named, ["right_id"], "inner", limit=limit)
    return left.join(
        pairs.withColumnRenamed("left_id", id_column), id_column, "inner"
    ).select(*left.columns, *values)
