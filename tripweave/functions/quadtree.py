"""Quad-tree cells of many polygons at once, in arrays of their edges.

Cells are cut level by level, those of all polygons together, so the steps of Python are as many as
levels and not as polygons. A pair is an edge in a cell; arrays over pairs are in the order of cells.

The rules are those of :mod:`tripweave.functions.geo`: pieces from west to east, arcs of great
circles unless the surface is the plane, a side that changes with each piece that is crossed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .geo import MARGIN, PLANE

#: Side of the cells of level 0, in degrees; each level halves it. Sides are exact, and the date
#: line and the poles are borders of cells on every level, so no way inside a cell passes them.
BASE_DEGREES = 90.0
# The centre is taken a little off the middle, where polygons of round numbers have no corner.
CENTRE_X, CENTRE_Y = 0.5137, 0.4863

#: Pairs that are looked at together: what is computed on the way stays small for any polygon.
BLOCK = 1 << 17

FIELDS = ("ax", "ay", "xl", "yl", "xr", "yr", "first", "nx", "ny", "nz")


def _vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    lng, lat = np.radians(x), np.radians(y)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], 1)


def _over_line_or_pole(x1: float, y1: float, x2: float, y2: float) -> list[tuple]:
    """The pieces of an arc that passes the date line or touches a pole."""
    pole, span = (90.0 if y1 + y2 >= 0 else -90.0), abs(x2 - x1)
    if abs(y1) == 90 and y1 == y2:
        return [(x1, y1, x2, y2)]
    if abs(y1) == 90:
        return [(x1, y1, x2, y1), (x2, y1, x2, y2)]
    if abs(y2) == 90:
        return [(x1, y1, x1, y2), (x1, y2, x2, y2)]
    if span == 360:
        return [(x1, y1, x1, y2)]
    if span == 180:
        return [(x1, y1, x1, pole), (x1, pole, x2, pole), (x2, pole, x2, y2)]
    a, b = _vectors(np.array([x1, x2]), np.array([y1, y2]))
    n = np.cross(a, b)
    meets = y1 if abs(x1) == 180 else y2 if abs(x2) == 180 else float(np.degrees(np.arctan(n[0] / n[2])))
    far = 180.0 if x1 > 0 else -180.0
    return [(x1, y1, far, meets), (-far, meets, x2, y2)]


def _split(
    x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, first: np.ndarray, ring: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of edges and their rings, with the few at the date line or a pole in pieces."""
    rows = np.stack([x1, y1, x2, y2, first], 1)
    span = np.abs(x2 - x1)
    odd = (span >= 180) | (np.abs(y1) == 90) | (np.abs(y2) == 90)
    if not odd.any():
        return rows, ring
    parts, at = [], []
    for k in np.flatnonzero(odd).tolist():
        for i, piece in enumerate(_over_line_or_pole(*rows[k, :4].tolist())):
            parts.append((*piece, rows[k, 4] if i == 0 else 0.0))
            at.append(k)
    low = (np.abs(y1) < 90) & (np.abs(y2) < 90)
    turns = np.bincount(ring[(span > 180) & (span < 360) & low])
    for around in np.flatnonzero(turns % 2 == 1):
        mine = np.flatnonzero(ring == around)
        if y1[mine].sum() > 0:
            parts.append((-180.0, 90.0, 180.0, 90.0, 0.0))
            at.append(mine[-1])
    key = np.concatenate([np.flatnonzero(~odd), at]).astype(int)
    order = np.argsort(key, kind="stable")
    return np.concatenate([rows[~odd], np.array(parts)])[order], ring[key[order]]


def ring_pieces(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, surface: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The pieces of rings of ``sizes`` points, and the ring of each.

    A ring keeps one piece marked ``first`` even where a point repeats.
    """
    ring, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    following, some = np.arange(1, len(x) + 1), sizes > 0
    following[(begin + sizes - 1)[some]] = begin[some]
    first = np.zeros(len(x))
    first[begin[some]] = 1
    rows = np.stack([x, y, x[following], y[following], first], 1)
    if surface != PLANE:
        rows, ring = _split(*rows.T, ring)
    x1, y1, x2, y2, first = rows.T
    keep = (first == 1) | (x1 != x2) | (y1 != y2)
    x1, y1, x2, y2, first = (v[keep] for v in (x1, y1, x2, y2, first))
    west = x1 <= x2
    out = {
        "ax": x1, "ay": y1, "xl": np.where(west, x1, x2), "yl": np.where(west, y1, y2),
        "xr": np.where(west, x2, x1), "yr": np.where(west, y2, y1), "first": first == 1,
    }
    if surface == PLANE:
        normal = np.full((len(x1), 3), np.nan)
    else:
        a, b = _vectors(out["xl"], out["yl"]), _vectors(out["xr"], out["yr"])
        normal = np.cross(a + b, b - a)
        length = np.sqrt((normal**2).sum(1))
        normal = normal / np.where(length > 0, length, 1.0)[:, None]
    return out | {"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2]}, ring[keep]


def _flat(rings: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.array([p[:2] for ring in rings for p in ring], float).reshape(-1, 2)
    return points[:, 0], points[:, 1], np.array([len(ring) for ring in rings], int)


def pieces(rings: list, surface: str) -> dict[str, np.ndarray]:
    """The pieces of all rings of one polygon."""
    return ring_pieces(*_flat(rings), surface)[0]


def _in_blocks(test: Callable[..., np.ndarray], *arrays: np.ndarray) -> np.ndarray:
    """A test of pairs, a block of them at a time."""
    parts = [test(*[a[i:i + BLOCK] for a in arrays]) for i in range(0, len(arrays[0]), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class Cells:
    """Cells and, in their order, the edges of each: ``counts`` tells how many it has."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        names = ("polygon", "level", "ci", "cj", "centre_in", "counts", "edges")
        for name, arrays in zip(names, zip(*parts)):
            setattr(self, name, np.concatenate(arrays))
        self.of_edge = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.counts)

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        size = BASE_DEGREES / 2.0**self.level
        return (self.ci + CENTRE_X) * size, (self.cj + CENTRE_Y) * size


class Polygons:
    """Polygons by their rings: of all points ``x`` and ``y``, ``sizes`` per ring, ``rings`` per polygon."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rings: np.ndarray, surface: str):
        self.edges, ring = ring_pieces(x, y, sizes, surface)
        self.owner = np.repeat(np.arange(len(rings)), rings)[ring]
        self.plane = surface == PLANE
        self.pole = np.abs(self.edges["yl"] + self.edges["yr"]) == 180

    def __len__(self) -> int:
        return len(self.edges["xl"])

    def _side(self, some: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = self.edges
        xl, yl, xr, yr = (e[n][some] for n in ("xl", "yl", "xr", "yr"))
        straight = (xr - xl) * (y - yl) - (x - xl) * (yr - yl)
        if self.plane:
            return straight
        p = _vectors(np.atleast_1d(x), np.atleast_1d(y))
        arc = e["nx"][some] * p[:, 0] + e["ny"][some] * p[:, 1] + e["nz"][some] * p[:, 2]
        return np.where(self.pole[some], straight, arc)

    def above(self, some: np.ndarray, x: np.ndarray, y: np.ndarray, parallel: np.ndarray) -> np.ndarray:
        """Which pieces pass north, of points that are one for all or one for each."""
        e = self.edges
        west, east = x < e["xl"][some], x >= e["xr"][some]
        return np.where(
            west, e["yl"][some] > parallel, np.where(east, e["yr"][some] > parallel, self._side(some, x, y) < 0)
        )

    def passes(self, some: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece has the point's longitude and passes north of it."""
        has = (self.edges["xl"][some] <= x) & (x < self.edges["xr"][some])
        return has & (self._side(some, x, y) < 0)

    def latitudes(self, some: np.ndarray, west: np.ndarray, east: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest latitude of pieces between two meridians that they reach."""
        e = {n: v[some] for n, v in self.edges.items()}
        upright = e["xl"] == e["xr"]
        flat = self.pole[some] | self.plane | upright
        l, r = np.maximum(e["xl"], west), np.minimum(e["xr"], east)

        def at(x: np.ndarray) -> np.ndarray:
            width = np.where(upright, 1.0, e["xr"] - e["xl"])
            out = e["yl"] + (x - e["xl"]) * (e["yr"] - e["yl"]) / width
            if not flat.all():
                lng, nz = np.radians(x), np.where(flat, 1.0, e["nz"])
                arc = np.degrees(np.arctan(-(e["nx"] * np.cos(lng) + e["ny"] * np.sin(lng)) / nz))
                out = np.where(flat, out, arc)
            return np.where(x <= e["xl"], e["yl"], np.where(x >= e["xr"], e["yr"], out))

        one, two = np.where(upright, e["yl"], at(l)), np.where(upright, e["yr"], at(r))
        low, high = np.minimum(one, two), np.maximum(one, two)
        if not flat.all():
            top = np.degrees(np.arccos(np.minimum(np.abs(e["nz"]), 1.0)))
            north, south = np.degrees(np.arctan2(-e["ny"], -e["nx"])), np.degrees(np.arctan2(e["ny"], e["nx"]))
            high = np.where(~flat & (l < north) & (north < r), np.maximum(high, top), high)
            low = np.where(~flat & (l < south) & (south < r), np.minimum(low, -top), low)
        return low, high

    def in_box(
        self, some: np.ndarray, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray
    ) -> np.ndarray:
        """Whether each of the pieces has a point in its box, taken a little larger."""
        west, east = xmin - MARGIN, xmax + MARGIN
        found = (self.edges["xr"][some] >= west) & (self.edges["xl"][some] <= east)
        low, high = self.latitudes(some[found], west[found], east[found])
        found[found] = (low <= ymax[found] + MARGIN) & (high >= ymin[found] - MARGIN)
        return found

    def _first_cells(self, max_level: int) -> tuple[np.ndarray, ...]:
        """The few cells about as large as each polygon: polygon, level, ci, cj; and all pairs."""
        begin = np.flatnonzero(np.diff(self.owner, prepend=-1))
        sizes = np.diff(begin, append=len(self))
        low, high = self.latitudes(np.arange(len(self)), -1e3, 1e3)
        box = [
            np.minimum.reduceat(self.edges["xl"], begin), np.minimum.reduceat(low, begin),
            np.maximum.reduceat(self.edges["xr"], begin), np.maximum.reduceat(high, begin),
        ]
        if not np.isfinite(box).all():
            raise ValueError("a ring has a point that is no position")
        span = np.maximum(np.maximum(box[2] - box[0], box[3] - box[1]), 1e-9)
        level = np.clip(np.floor(np.log2(BASE_DEGREES / span)), 0, max_level).astype(int)
        size, most = BASE_DEGREES / 2.0**level, 2**level
        i0, j0, i1, j1 = (
            np.floor((v + m) / size).astype(int) for v, m in zip(box, (-MARGIN, -MARGIN, MARGIN, MARGIN))
        )
        i0, i1 = np.maximum(i0, -2 * most), np.minimum(i1, 2 * most - 1)
        j0, j1 = np.maximum(j0, -most), np.minimum(j1, most - 1)
        wide, tall = np.maximum(i1 - i0 + 1, 0), np.maximum(j1 - j0 + 1, 0)
        number = wide * tall
        shape = np.repeat(np.arange(len(begin)), number)
        k = np.arange(len(shape)) - np.repeat(np.cumsum(number) - number, number)
        ci, cj = i0[shape] + k // tall[shape], j0[shape] + k % tall[shape]
        cell = np.repeat(np.arange(len(shape)), sizes[shape])
        before = np.cumsum(sizes[shape]) - sizes[shape]
        edge = np.arange(len(cell)) + (begin[shape] - before)[cell]
        return self.owner[begin][shape], level[shape], ci, cj, cell, edge

    def cells(self, leaf_edges: int, max_level: int) -> Cells | None:
        """The cells that the polygons touch, None if there is none."""
        if not len(self):
            return None
        polygon, level, ci, cj, cell, edge = self._first_cells(max_level)
        size = BASE_DEGREES / 2.0**level
        x, y = (ci + CENTRE_X) * size, (cj + CENTRE_Y) * size
        north = _in_blocks(lambda e, c: self.passes(e, x[c], y[c]), edge, cell)
        inside = np.bincount(cell[north], minlength=len(level)) % 2 == 1
        todo = _touched(
            (polygon, level, ci, cj, inside), cell, edge, self._reach(cell, edge, ci, cj, size)
        )
        out = []
        while len(todo[0][0]):
            (polygon, level, ci, cj, inside), cell, edge = todo
            counts = np.bincount(cell, minlength=len(level))
            done = (counts <= leaf_edges) | (level >= max_level)
            out.append((*(v[done] for v in todo[0]), counts[done], edge[done[cell]]))
            todo = self._cut(*_only(~done, *todo))
        return Cells(out) if out else None

    def _reach(self, cell: np.ndarray, edge: np.ndarray, ci: np.ndarray, cj: np.ndarray, size: np.ndarray) -> np.ndarray:
        sides = ci * size, cj * size, (ci + 1) * size, (cj + 1) * size
        return _in_blocks(lambda e, c: self.in_box(e, *[v[c] for v in sides]), edge, cell)

    def _cut(self, cells: tuple[np.ndarray, ...], cell: np.ndarray, edge: np.ndarray) -> tuple:
        """The quarters of cells that the polygons touch, in the order of quarters."""
        polygon, level, ci, cj, inside = cells
        size = BASE_DEGREES / 2.0**level
        cx, cy, half = (ci + CENTRE_X) * size, (cj + CENTRE_Y) * size, size / 2
        past = _in_blocks(lambda e, c: self.above(e, cx[c], cy[c], cy[c]), edge, cell)
        quarters, number = [], 0
        for qi in (2 * ci, 2 * ci + 1):
            for qj in (2 * cj, 2 * cj + 1):
                x, y = (qi + CENTRE_X) * half, (qj + CENTRE_Y) * half
                turned = _in_blocks(lambda e, c, p: self.above(e, x[c], y[c], cy[c]) != p, edge, cell, past)
                here = inside != (np.bincount(cell[turned], minlength=len(level)) % 2 == 1)
                found, c, e = _touched(
                    (polygon, level + 1, qi, qj, here), cell, edge, self._reach(cell, edge, qi, qj, half)
                )
                quarters.append((*found, c + number, e))
                number += len(found[0])
        *merged, cell, edge = (np.concatenate(v) for v in zip(*quarters))
        return tuple(merged), cell, edge


def _only(chosen: np.ndarray, cells: tuple[np.ndarray, ...], cell: np.ndarray, edge: np.ndarray) -> tuple:
    """Some of the cells, numbered anew, and their pairs."""
    mine = chosen[cell]
    return tuple(v[chosen] for v in cells), (np.cumsum(chosen) - 1)[cell[mine]], edge[mine]


def _touched(cells: tuple[np.ndarray, ...], cell: np.ndarray, edge: np.ndarray, near: np.ndarray) -> tuple:
    """Cells that an edge is near to, or that lie inside; their pairs are the near edges."""
    cell, edge = cell[near], edge[near]
    return _only(cells[4] | (np.bincount(cell, minlength=len(cells[0])) > 0), cells, cell, edge)


class Polygon(Polygons):
    """One polygon, by lists of points."""

    def __init__(self, rings: list, surface: str):
        super().__init__(*_flat(rings), np.array([len(rings)]), surface)

    def inside(self, x: float, y: float) -> bool:
        return bool(self.passes(np.arange(len(self)), x, y).sum() % 2)

    def cells(self, leaf_edges: int, max_level: int) -> list[tuple[int, int, int, bool, np.ndarray]]:
        """(level, ci, cj, centre_in, edges) of the cells that the polygon touches."""
        found = super().cells(leaf_edges, max_level)
        if found is None:
            return []
        edges = np.split(found.edges, np.cumsum(found.counts)[:-1])
        columns = (found.level, found.ci, found.cj, found.centre_in)
        return list(zip(*(v.tolist() for v in columns), edges))
