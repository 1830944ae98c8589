"""Geometry of longitudes and latitudes, as expressions over arrays.

A polygon is an array of rings of ``[lng, lat]`` points (see :mod:`tripweave.schemas`). Its edges
are an array of structs, each of them a piece that runs from west (``xl, yl``) to east
(``xr, yr``). On the sphere an edge is the shorter arc of a great circle between two vertices;
``nx, ny, nz`` is the unit normal of its plane, on the northern side. An arc over the date line
is two pieces, one over a pole the meridians up to it and a piece along it. On the plane an edge
is straight in lng and lat, and the normal is NULL: so a list of edges says itself on which
surface it was made.

A point is inside when an odd number of pieces passes north of it. A piece passes a point that
has its longitude in ``[xl, xr)``; which side it passes is the sign of one product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
SPHERE, PLANE = "sphere", "plane"
#: Points nearer to an arc than this angle, in radians, lie on it: about ten nanometres.
ON_ARC = 2e-15
#: Degrees by which a box is enlarged when edges are looked for, against rounding.
MARGIN = 1e-9


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres; NULL for a position that is NULL or not finite."""
    half_lat = F.radians(lat2 - lat1) / F.lit(2e0)
    half_lng = F.radians(lng2 - lng1) / F.lit(2e0)
    chord = F.pow(F.sin(half_lat), F.lit(2e0)) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), F.lit(2e0))
    )
    # Not least(): it would skip a NULL chord. NaN compares as larger than any number.
    chord = F.when(chord <= 1e0, chord).when((chord > 1e0) & ~F.isnan(chord), F.lit(1e0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def is_position(lng: Column, lat: Column) -> Column:
    """True for finite coordinates with a latitude that exists, else false, never NULL."""
    return F.coalesce((F.abs(lng) <= 540) & (F.abs(lat) <= 90), F.lit(False))


def line(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    return F.array(F.array(lng1, lat1), F.array(lng2, lat2))


def geojson(kind: str | Column, coordinates: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.to_json(F.struct(kind.alias("type"), coordinates.alias("coordinates")))


def geom_type(geojson_text: Column) -> Column:
    """The type named by a GeoJSON text."""
    return F.get_json_object(geojson_text, "$.type")


def stored_rings(geojson_text: Column) -> Column:
    """All rings of a stored Polygon or MultiPolygon; NULL for other kinds and damaged text.

    Parts and holes become rings of one array, whatever their orientation: inside means inside an
    odd number of rings.
    """

    def coordinates(kind: str) -> Column:
        return F.from_json(geojson_text, f"coordinates {kind}")["coordinates"]

    kind = geom_type(geojson_text)
    rings = F.when(kind == "Polygon", coordinates("array<array<array<double>>>")).when(
        kind == "MultiPolygon", F.flatten(coordinates("array<array<array<array<double>>>>"))
    )

    def sound(ring: Column) -> Column:
        return (F.size(ring) >= 3) & F.forall(
            ring, lambda p: (F.size(p) >= 2) & is_position(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
        )

    return F.when(F.coalesce(F.forall(rings, sound), F.lit(False)), rings)


def stored_point(geojson_text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a stored Point; NULL for other kinds and damaged text."""
    place = F.from_json(geojson_text, "coordinates array<double>")["coordinates"]
    place = F.when(geom_type(geojson_text) == "Point", place)
    return F.get(place, F.lit(0)), F.get(place, F.lit(1))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle as a polygon of one closed ring."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(F.array(*[F.array(x, y) for x, y in corners]))


def _vector(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a position, as doubles."""
    lng, lat = F.radians(x), F.radians(y)
    return F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat)


def _piece(x1: Column, y1: Column, x2: Column, y2: Column, first: Column) -> Column:
    names = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    return F.struct(*[v.cast("double").alias(n) for n, v in names.items()], first.alias("first"))


def _spherical_pieces(e: Column) -> Column:
    """The pieces of one edge: cut at the date line, led over a pole along meridians."""
    x1, y1, x2, y2, first, no = e["x1"], e["y1"], e["x2"], e["y2"], e["first"], F.lit(False)
    span = F.abs(x2 - x1)
    pole = F.when(y1 + y2 >= 0, F.lit(90e0)).otherwise(F.lit(-90e0))
    side = F.when(x1 > 0, F.lit(180e0)).otherwise(F.lit(-180e0))
    ax, ay, az = _vector(x1, y1)
    bx, by, bz = _vector(x2, y2)
    # Where the arc meets the date line: there its normal's x over z is the tangent of the latitude.
    crossing = F.degrees(F.atan((ay * bz - az * by) / (ax * by - ay * bx)))
    crossing = F.when(F.abs(x1) == 180, y1).when(F.abs(x2) == 180, y2).otherwise(crossing)
    at_pole_1, at_pole_2 = F.abs(y1) == 90, F.abs(y2) == 90
    return (
        F.when(at_pole_1 & (y1 == y2), F.array(_piece(x1, y1, x2, y2, first)))
        .when(at_pole_1, F.array(_piece(x1, y1, x2, y1, first), _piece(x2, y1, x2, y2, no)))
        .when(at_pole_2, F.array(_piece(x1, y1, x1, y2, first), _piece(x1, y2, x2, y2, no)))
        .when(span == 360, F.array(_piece(x1, y1, x1, y2, first)))
        .when(span == 180, F.array(
            _piece(x1, y1, x1, pole, first), _piece(x1, pole, x2, pole, no), _piece(x2, pole, x2, y2, no)
        ))
        .when(span > 180, F.array(_piece(x1, y1, side, crossing, first), _piece(-side, crossing, x2, y2, no)))
        .otherwise(F.array(_piece(x1, y1, x2, y2, first)))
    )


def _oriented(surface: str):
    def edge(e: Column) -> Column:
        west = e["x1"] <= e["x2"]
        ends = {
            "xl": F.when(west, e["x1"]).otherwise(e["x2"]), "yl": F.when(west, e["y1"]).otherwise(e["y2"]),
            "xr": F.when(west, e["x2"]).otherwise(e["x1"]), "yr": F.when(west, e["y2"]).otherwise(e["y1"]),
        }
        return F.struct(
            e["x1"].alias("ax"), e["y1"].alias("ay"), *[v.alias(n) for n, v in ends.items()], e["first"].alias("first")
        )

    def with_normal(e: Column) -> Column:
        plain = [e[n].alias(n) for n in ("ax", "ay", "xl", "yl", "xr", "yr", "first")]
        if surface == PLANE:
            none = F.lit(None).cast("double")
            return F.struct(*plain, *[none.alias(n) for n in ("nx", "ny", "nz")])
        a, b = _vector(e["xl"], e["yl"]), _vector(e["xr"], e["yr"])
        # (a + b) x (b - a), twice a x b without the loss where a and b are near.
        d, s = [q - p for p, q in zip(a, b)], [p + q for p, q in zip(a, b)]
        raw = [s[1] * d[2] - s[2] * d[1], s[2] * d[0] - s[0] * d[2], s[0] * d[1] - s[1] * d[0]]
        return F.struct(*plain, *[v.alias(n) for n, v in zip(("nx", "ny", "nz"), raw)])

    def unit(e: Column) -> Column:
        plain = [e[n].alias(n) for n in ("ax", "ay", "xl", "yl", "xr", "yr", "first")]
        length = F.sqrt(e["nx"] * e["nx"] + e["ny"] * e["ny"] + e["nz"] * e["nz"])
        length = F.when(length > 0, length).when(length.isNotNull(), F.lit(1e0))
        return F.struct(*plain, *[(e[n] / length).alias(n) for n in ("nx", "ny", "nz")])

    return edge, with_normal, unit


def edges(rings: Column, surface: str = SPHERE) -> Column:
    """All edges of all rings as west-to-east pieces.

    Rings that do not close are closed and repeated points skipped, except that each ring keeps
    one piece marked ``first``: ``ax, ay`` is a point of the ring. A ring around a pole, which
    passes the date line an odd number of times and does not touch the pole, holds the pole of
    the hemisphere that its vertices are in by their mean.
    """

    def ring_edges(ring: Column) -> Column:
        def to_next(point: Column, i: Column) -> Column:
            following = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(F.lit(0)))
            ends = [F.get(p, F.lit(k)) for p in (point, following) for k in (0, 1)]
            return _piece(*ends, i == 0)

        raw = F.transform(ring, to_next)
        if surface == PLANE:
            return raw
        pieces = F.flatten(F.transform(raw, _spherical_pieces))
        passes = F.filter(
            raw, lambda e: F.abs(e["x2"] - e["x1"]).between(180.0000000001, 359.9999999999)
            & (F.abs(e["y1"]) < 90) & (F.abs(e["y2"]) < 90)
        )
        north = F.aggregate(ring, F.lit(0e0), lambda total, p: total + F.get(p, F.lit(1))) > 0
        along_pole = _piece(F.lit(-180e0), F.lit(90e0), F.lit(180e0), F.lit(90e0), F.lit(False))
        return F.when((F.size(passes) % 2 == 1) & north, F.concat(pieces, F.array(along_pole))).otherwise(pieces)

    raw = F.filter(
        F.flatten(F.transform(rings, ring_edges)),
        lambda e: e["first"] | (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]),
    )
    for step in _oriented(surface):
        raw = F.transform(raw, step)
    return raw


def side(e: Column, x: Column, y: Column) -> Column:
    """Positive where the point is north of the piece's line, negative south, zero on it."""
    px, py, pz = _vector(x, y)
    arc = e["nx"] * px + e["ny"] * py + e["nz"] * pz
    straight = (e["xr"] - e["xl"]) * (y - e["yl"]) - (x - e["xl"]) * (e["yr"] - e["yl"])
    pole = F.abs(e["yl"] + e["yr"]) == 180
    return F.when(e["nx"].isNull() | pole, straight).otherwise(arc)


def has(e: Column, x: Column) -> Column:
    """The piece passes the meridian at ``x``; a vertex belongs to the piece east of it."""
    return (e["xl"] <= x) & (x < e["xr"])


def passes(e: Column, x: Column, y: Column) -> Column:
    """The piece passes north of the point, or, where it does not reach the meridian, its end does.

    On the way along a parallel and a meridian between two points, a piece is crossed an odd
    number of times when this differs for the two, both taken at the parallel's latitude for
    pieces that the meridian misses: see :func:`crossed`.
    """
    return F.when(x < e["xl"], e["yl"] > y).when(x >= e["xr"], e["yr"] > y).otherwise(side(e, x, y) < 0)


def above(e: Column, x: Column, y: Column, parallel: Column) -> Column:
    """As :func:`passes`, with ends judged at the latitude ``parallel`` of the way."""
    return (
        F.when(x < e["xl"], e["yl"] > parallel).when(x >= e["xr"], e["yr"] > parallel)
        .otherwise(side(e, x, y) < 0)
    )


def crossed(e: Column, x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """The piece is crossed an odd number of times between (x, y) and (cx, cy).

    The way leads along the meridian of x to the latitude cy and along that parallel.
    """
    return above(e, x, y, cy) != passes(e, cx, cy)


def on_edge(e: Column, x: Column, y: Column) -> Column:
    vertex = ((x == e["xl"]) & (y == e["yl"])) | ((x == e["xr"]) & (y == e["yr"]))
    upright = (e["xl"] == e["xr"]) & (x == e["xl"]) & (F.least(e["yl"], e["yr"]) <= y) & (y <= F.greatest(e["yl"], e["yr"]))
    near = F.when(e["nx"].isNull(), side(e, x, y) == 0).otherwise(F.abs(side(e, x, y)) <= ON_ARC)
    return vertex | upright | ((e["xl"] < x) & (x < e["xr"]) & near)


def odd(selected: Column) -> Column:
    return F.size(selected) % 2 == 1


def in_edges(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; says nothing definite about points on an edge."""
    return odd(F.filter(edge_list, lambda e: has(e, x) & (side(e, x, y) < 0)))


def on_edges(edge_list: Column, x: Column, y: Column) -> Column:
    return F.exists(edge_list, lambda e: on_edge(e, x, y))


def point_within(lng: Column, lat: Column, rings: Column, surface: str = SPHERE) -> Column:
    """Inside, the boundary not included."""
    e = edges(rings, surface)
    return in_edges(e, lng, lat) & ~on_edges(e, lng, lat)


def point_intersects(lng: Column, lat: Column, rings: Column, surface: str = SPHERE) -> Column:
    """Inside or on the boundary."""
    e = edges(rings, surface)
    return in_edges(e, lng, lat) | on_edges(e, lng, lat)


def _product(e: Column, x: Column, y: Column) -> Column:
    px, py, pz = _vector(x, y)
    return e["nx"] * px + e["ny"] * py + e["nz"] * pz


def edges_meet(e: Column, f: Column) -> Column:
    """Two pieces share a point: they cross, or an end of one lies on the other."""
    touch = (
        on_edge(e, f["xl"], f["yl"]) | on_edge(e, f["xr"], f["yr"])
        | on_edge(f, e["xl"], e["yl"]) | on_edge(f, e["xr"], e["yr"])
    )
    # Four triangles turn the same way where two arcs cross, and not where one crosses the
    # other's antipode.
    ec, ed = _product(e, f["xl"], f["yl"]), _product(e, f["xr"], f["yr"])
    fa, fb = _product(f, e["xl"], e["yl"]), _product(f, e["xr"], e["yr"])
    arcs = (ec * ed < 0) & (fa * fb < 0) & (ec * fb > 0)
    overlap = (
        (e["xl"] <= f["xr"]) & (f["xl"] <= e["xr"])
        & (F.least(e["yl"], e["yr"]) <= F.greatest(f["yl"], f["yr"]))
        & (F.least(f["yl"], f["yr"]) <= F.greatest(e["yl"], e["yr"]))
    )
    sides = [
        F.signum(side(a, b["xl"], b["yl"])) * F.signum(side(a, b["xr"], b["yr"])) <= 0
        for a, b in ((e, f), (f, e))
    ]
    straight = overlap & sides[0] & sides[1]
    return F.when(e["nx"].isNull(), straight).otherwise(arcs | touch)


def edge_lists_meet(a: Column, b: Column) -> Column:
    return F.exists(a, lambda e: F.exists(b, lambda f: edges_meet(e, f)))


def latitudes(e: Column, west: Column, east: Column) -> tuple[Column, Column]:
    """Least and largest latitude of the piece between two meridians that it reaches."""

    def at(x: Column) -> Column:
        lng = F.radians(x)
        arc = F.degrees(F.atan(-(e["nx"] * F.cos(lng) + e["ny"] * F.sin(lng)) / e["nz"]))
        straight = e["yl"] + (x - e["xl"]) * (e["yr"] - e["yl"]) / (e["xr"] - e["xl"])
        flat = e["nx"].isNull() | (F.abs(e["yl"] + e["yr"]) == 180)
        inner = F.when(flat, straight).otherwise(arc)
        return F.when(x <= e["xl"], e["yl"]).when(x >= e["xr"], e["yr"]).otherwise(inner)

    l, r = F.greatest(e["xl"], west), F.least(e["xr"], east)
    upright = e["xl"] == e["xr"]
    ends = [F.when(upright, y).otherwise(at(x)) for y, x in ((e["yl"], l), (e["yr"], r))]
    low, high = F.least(*ends), F.greatest(*ends)
    # A great circle is farthest north on one meridian and farthest south on the opposite one.
    top = F.degrees(F.acos(F.least(F.abs(e["nz"]), F.lit(1e0))))
    north, south = F.degrees(F.atan2(-e["ny"], -e["nx"])), F.degrees(F.atan2(e["ny"], e["nx"]))
    round_ = e["nx"].isNotNull() & ~upright & (F.abs(e["yl"] + e["yr"]) != 180)
    high = F.when(round_ & (l < north) & (north < r), F.greatest(high, top)).otherwise(high)
    low = F.when(round_ & (l < south) & (south < r), F.least(low, -top)).otherwise(low)
    return low, high


def edge_meets_box(e: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The piece has a point in the box, which is taken a little larger."""
    west, east = xmin - MARGIN, xmax + MARGIN
    low, high = latitudes(e, west, east)
    return F.when((e["xr"] < west) | (e["xl"] > east), F.lit(False)).otherwise(
        (low <= ymax + MARGIN) & (high >= ymin - MARGIN)
    )


def polygons_intersect(a: Column, b: Column, surface: str = SPHERE) -> Column:
    """Two polygons share a point: edges meet, or one point of some ring lies in the other."""
    ea, eb = edges(a, surface), edges(b, surface)
    return (
        edge_lists_meet(ea, eb)
        | F.exists(ea, lambda e: e["first"] & in_edges(eb, e["ax"], e["ay"]))
        | F.exists(eb, lambda e: e["first"] & in_edges(ea, e["ax"], e["ay"]))
    )
