"""Planar geometry on polygon columns, with built-in higher-order functions only.

A polygon column is ``array<array<array<struct<x:double,y:double>>>>``: polygons, each a list of rings
(the first one is the outer ring), each a closed list of points. These expressions are meant for
the area dimension and for drawn selections, never for single fact rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions.scalars import number_text

TOLERANCE = 1e-9


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------------------------
# Text <-> polygons


def parse_polygons(wkt: str | Column) -> Column:
    """Polygons of a POLYGON or MULTIPOLYGON text (an SRID prefix is allowed); NULL for anything else."""
    text = F.regexp_replace(_col(wkt), r"^\s*SRID=\d+;", "")
    body = F.regexp_extract(text, r"(?is)^\s*(?:MULTI)?POLYGON\s*\((.*)\)\s*$", 1)
    polygons = F.when(
        F.upper(F.ltrim(text)).startswith("MULTI"), F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")
    ).otherwise(F.array(body))

    def point(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")
        )

    def ring(text: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), point)

    def polygon(text: Column) -> Column:
        return F.transform(F.split(text, r"\)\s*,\s*\("), ring)

    return F.when(F.length(body) > 0, F.transform(polygons, polygon))


def ring_text(ring: Column) -> Column:
    """``(x y,x y,...)``."""
    return F.concat(
        F.lit("("),
        F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", number_text(p["x"]), number_text(p["y"]))), ","),
        F.lit(")"),
    )


def polygon_body(polygon: Column) -> Column:
    """``((x y,...),(x y,...))``: one polygon without the type name."""
    return F.concat(F.lit("("), F.array_join(F.transform(polygon, ring_text), ","), F.lit(")"))


def polygon_text(polygon: Column) -> Column:
    return F.concat(F.lit("POLYGON "), polygon_body(polygon))


def with_srid(wkt: str | Column, srid: int = S.CRS) -> Column:
    return F.concat(F.lit(f"SRID={srid};"), _col(wkt))


# ---------------------------------------------------------------------------------------------
# Measures


def outer_rings(polygons: str | Column) -> Column:
    return F.transform(_col(polygons), lambda polygon: F.get(polygon, F.lit(0)))


def outer_points(polygons: str | Column) -> Column:
    return F.flatten(outer_rings(polygons))


def bounding_box(polygons: str | Column) -> dict[str, Column]:
    points = outer_points(polygons)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def edges(ring: Column) -> Column:
    """Edges of a closed ring as ``array<struct<x1,y1,x2,y2>>``."""
    starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def outer_edges(polygons: str | Column) -> Column:
    return F.flatten(F.transform(outer_rings(polygons), edges))


def all_edges(polygons: str | Column) -> Column:
    """Edges of all rings, holes included."""
    return F.flatten(F.transform(F.flatten(_col(polygons)), edges))


def _ring_moments(ring: Column, weight: Column) -> Column:
    """Area and first moments of a ring about its own first point, made positive and times ``weight``."""
    origin = F.get(ring, F.lit(0))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "mx", "my")])

    def add(acc: Column, e: Column) -> Column:
        x1, y1 = e["x1"] - origin["x"], e["y1"] - origin["y"]
        x2, y2 = e["x2"] - origin["x"], e["y2"] - origin["y"]
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + (x1 + x2) * cross / 6).alias("mx"),
            (acc["my"] + (y1 + y2) * cross / 6).alias("my"),
        )

    def finish(acc: Column) -> Column:
        sign = F.signum(acc["a"]) * weight
        return F.struct(
            (acc["a"] * sign).alias("a"),
            ((acc["mx"] + origin["x"] * acc["a"]) * sign).alias("mx"),
            ((acc["my"] + origin["y"] * acc["a"]) * sign).alias("my"),
        )

    return F.aggregate(edges(ring), zero, add, finish)


def centroid(polygons: str | Column) -> Column:
    """Area-weighted centroid ``struct<x,y>``; holes count as negative area. NULL for a zero area."""
    moments = F.flatten(
        F.transform(
            _col(polygons),
            lambda polygon: F.transform(
                polygon, lambda ring, i: _ring_moments(ring, F.when(i == 0, 1.0).otherwise(-1.0))
            ),
        )
    )
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "mx", "my")])
    total = F.aggregate(
        moments,
        zero,
        lambda acc, m: F.struct(*[(acc[n] + m[n]).alias(n) for n in ("a", "mx", "my")]),
        lambda acc: F.when(acc["a"] != 0, F.struct((acc["mx"] / acc["a"]).alias("x"), (acc["my"] / acc["a"]).alias("y"))),
    )
    return total


def disc(cx: str | Column, cy: str | Column, radius: float = 1.0, segments: int = 120) -> Column:
    """Polygons column holding a regular ``segments``-gon round a point, coordinates rounded to 6 places."""
    cx, cy = _col(cx), _col(cy)

    def vertex(i: Column) -> Column:
        angle = (i % segments) * F.lit(2 * math.pi / segments)
        return F.struct(
            F.round(cx + radius * F.cos(angle), 6).alias("x"), F.round(cy + radius * F.sin(angle), 6).alias("y")
        )

    return F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(segments)), vertex)))


def rectangle_wkt(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Text of the rectangle with opposite corners (x1, y1) and (x2, y2), given as texts, starting at (x1, y2)."""
    corners = [(x1, y2), (x2, y2), (x2, y1), (x1, y1), (x1, y2)]
    pairs = [F.concat_ws(" ", x, y) for x, y in corners]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(",", *pairs), F.lit("))"))


# ---------------------------------------------------------------------------------------------
# One selection polygon, known when the plan is built


Ring = tuple[tuple[float, float], ...]
PROBE = 1e-6  # how far beside an edge a region is probed, in degrees


def _rings_of(body: str) -> tuple[Ring, ...]:
    rings = []
    for text in re.findall(r"\(([^()]*)\)", body):
        points = tuple(tuple(float(v) for v in pair.split()[:2]) for pair in text.split(","))
        if len(points) < 4 or points[0] != points[-1]:
            raise ValueError("the rings of a selection must be closed and have at least three corners")
        rings.append(points)
    return tuple(rings)


@dataclass(frozen=True)
class SelectionPolygon:
    """A polygon or several, with or without holes, given as text; small enough to be a literal of the plan.

    What is inside is told by the even-odd rule over all rings, so a part within a hole counts again.
    """

    parts: tuple[tuple[Ring, ...], ...]  # of each part the outer ring and its holes

    @staticmethod
    def from_wkt(wkt: str) -> "SelectionPolygon":
        ring = r"\(\s*[^()]+\)"
        part = rf"\(\s*{ring}(?:\s*,\s*{ring})*\s*\)"
        text = re.sub(r"(?i)^\s*(?:SRID=\d+;)?\s*", "", wkt)
        if re.fullmatch(rf"(?is)POLYGON\s*{part}\s*", text):
            bodies = [text]
        elif re.fullmatch(rf"(?is)MULTIPOLYGON\s*\(\s*{part}(?:\s*,\s*{part})*\s*\)\s*", text):
            bodies = re.findall(part, text[text.index("(") + 1 :])
        else:
            raise ValueError("a selection must be a POLYGON or a MULTIPOLYGON")
        return SelectionPolygon(tuple(map(_rings_of, bodies)))

    @property
    def rings(self) -> tuple[Ring, ...]:
        return tuple(ring for part in self.parts for ring in part)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        points = [p for part in self.parts for p in part[0]]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def is_rectangle(self) -> bool:
        if len(self.rings) != 1:
            return False
        points = self.rings[0]
        xmin, ymin, xmax, ymax = self.bbox
        corners = {(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)}
        steps = zip(points, points[1:])
        return (
            len(points) == 5
            and set(points) == corners
            and len(corners) == 4
            and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in steps)
        )

    def _sides(self) -> list[tuple[float, float, float, float]]:
        """The edges of all rings. An edge that two parts share bounds nothing and is left out."""
        found = [a + b for ring in self.rings for a, b in zip(ring, ring[1:]) if a != b]
        count = Counter(min(e, e[2:] + e[:2]) for e in found)
        return [e for e in found if count[min(e, e[2:] + e[:2])] % 2]

    def contains(self, x: float, y: float) -> bool:
        """Whether a point that is on no edge lies inside."""
        crossed = 0
        for x1, y1, x2, y2 in self._sides():
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                crossed += 1
        return crossed % 2 == 1

    def _probes(self) -> list[tuple[float, float]]:
        """Points just outside, one beside each edge: every hole, and every gap between parts, has some."""
        if len(self.rings) == 1:
            return []  # what a single ring leaves out reaches to infinity, so no area can enclose it
        points = []
        for x1, y1, x2, y2 in self._sides():
            length = math.hypot(x2 - x1, y2 - y1)
            dx, dy = PROBE * (y1 - y2) / length, PROBE * (x2 - x1) / length
            x, y = (x1 + x2) / 2, (y1 + y2) / 2
            points += [p for p in ((x + dx, y + dy), (x - dx, y - dy)) if not self.contains(*p)]
        return points

    def _edges(self) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in self._sides()])

    def covers_box(self, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
        """Bounding-box containment: necessary for any polygon, exact for a rectangle. Can be pushed to parquet."""
        x0, y0, x1, y1 = self.bbox
        return (
            (_col(xmin) >= F.lit(x0)) & (_col(xmax) <= F.lit(x1)) & (_col(ymin) >= F.lit(y0)) & (_col(ymax) <= F.lit(y1))
        )

    def covers(self, polygons: str | Column, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
        """True where every polygon lies inside; touching the boundary counts as inside.

        When no edge of the selection meets the bounding box, everything in the box is on one side and one
        point decides. Otherwise each edge of the tested ring is cut wherever it meets an edge of the
        selection. Between two cuts a piece is wholly inside or wholly outside, so its midpoint decides.
        A ring that is inside may still enclose a hole, or a gap between parts. It then encloses all of it, and so
        the points probed beside the edges there.
        """
        sel_edges = self._edges()
        box = [_col(c) for c in (xmin, ymin, xmax, ymax)]

        def piece_ok(edge: Column) -> Column:
            def inside(position: Column) -> Column:
                x = edge["x1"] + position * (edge["x2"] - edge["x1"])
                y = edge["y1"] + position * (edge["y2"] - edge["y1"])
                return point_in_ring(x, y, sel_edges)

            def all_spans(cuts: Column) -> Column:
                def ok(i: Column) -> Column:
                    start, end = cuts[i - 1], cuts[i]
                    return (end - start <= TOLERANCE) | inside((start + end) / 2)

                return F.forall(F.sequence(F.lit(1), F.size(cuts) - 1), ok)

            found = F.flatten(F.transform(sel_edges, lambda s: _cut_positions(edge, s)))
            cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found))
            return F.transform(F.array(cuts), all_spans)[0]  # the list is bound once, not computed per span

        start = F.get(F.get(F.get(_col(polygons), F.lit(0)), F.lit(0)), F.lit(0))
        near = F.exists(sel_edges, lambda e: edge_meets_box(e, *box))
        within = F.forall(outer_edges(polygons), piece_ok)
        if probes := self._probes():
            own_edges = all_edges(polygons)
            points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in probes])
            near_box = lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3])
            within &= ~F.exists(points, lambda p: near_box(p) & crosses_odd(p["x"], p["y"], own_edges))
        return F.when(~near, point_in_ring(start["x"], start["y"], sel_edges)).otherwise(within)


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _cut_positions(edge: Column, other: Column) -> Column:
    """Positions (0..1) along ``edge`` where it meets ``other``; both overlap ends when collinear."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    ox, oy = other["x2"] - other["x1"], other["y2"] - other["y1"]
    qx, qy = other["x1"] - edge["x1"], other["y1"] - edge["y1"]
    turn = _cross(dx, dy, ox, oy)
    length2 = dx * dx + dy * dy
    divisor = F.when(turn != 0, turn)
    along, across = _cross(qx, qy, ox, oy) / divisor, _cross(qx, qy, dx, dy) / divisor
    meet = F.when(
        along.between(-TOLERANCE, 1 + TOLERANCE) & across.between(-TOLERANCE, 1 + TOLERANCE), F.array(along)
    )
    divisor2 = F.when((turn == 0) & (length2 > 0), length2)
    end1 = (qx * dx + qy * dy) / divisor2
    end2 = ((other["x2"] - edge["x1"]) * dx + (other["y2"] - edge["y1"]) * dy) / divisor2
    overlap = F.when(F.abs(_cross(qx, qy, dx, dy)) <= TOLERANCE * divisor2, F.array(end1, end2))
    found = F.coalesce(meet, overlap, F.array().cast("array<double>"))
    return F.filter(found, lambda t: (t > 0) & (t < 1))


def edges_meet(a: Column, b: Column) -> Column:
    """Whether two segments share a point: neither's line has the other wholly on one side, and their boxes meet."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum(_cross(e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"]))

    apart = [
        F.greatest(p[f"{axis}1"], p[f"{axis}2"]) < F.least(q[f"{axis}1"], q[f"{axis}2"])
        for p, q in ((a, b), (b, a))
        for axis in ("x", "y")
    ]
    split = [side(p, q["x1"], q["y1"]) * side(p, q["x2"], q["y2"]) <= 0 for p, q in ((a, b), (b, a))]
    return ~(apart[0] | apart[1] | apart[2] | apart[3]) & split[0] & split[1]


def point_on_edges(px: Column, py: Column, ring_edges: Column) -> Column:
    def on(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        qx, qy = px - e["x1"], py - e["y1"]
        length2 = dx * dx + dy * dy
        along = qx * dx + qy * dy
        return (
            (F.abs(_cross(dx, dy, qx, qy)) <= TOLERANCE * F.greatest(F.sqrt(length2), F.lit(1.0)))
            & (along >= -TOLERANCE)
            & (along <= length2 + TOLERANCE)
        )

    return F.exists(ring_edges, on)


def crosses_odd(px: Column, py: Column, ring_edges: Column) -> Column:
    """Ray casting: whether a point is inside by the even-odd rule; on an edge it may be either."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > py) != (e["y2"] > py)
        at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.when(straddles, e["y2"] - e["y1"])
        return F.coalesce(straddles & (px < at), F.lit(False))

    return F.size(F.filter(ring_edges, crosses)) % 2 == 1


def point_in_ring(px: Column, py: Column, ring_edges: Column) -> Column:
    """Closed point-in-polygon test by ray casting, over the edges of all rings."""
    return point_on_edges(px, py, ring_edges) | crosses_odd(px, py, ring_edges)


def edge_meets_box(e: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """True when a segment and a closed box share a point: no axis and not the segment's normal separates them."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    corners = ((xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax))
    sides = [_cross(dx, dy, x - e["x1"], y - e["y1"]) for x, y in corners]
    return (
        (F.least(e["x1"], e["x2"]) <= xmax)
        & (F.greatest(e["x1"], e["x2"]) >= xmin)
        & (F.least(e["y1"], e["y2"]) <= ymax)
        & (F.greatest(e["y1"], e["y2"]) >= ymin)
        & (F.least(*sides) <= 0)
        & (F.greatest(*sides) >= 0)
    )


def ring_touches_box(ring_edges: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """True when the closed polygon with these edges and the closed box share a point."""
    corner_inside = F.exists(ring_edges, lambda e: e["x1"].between(xmin, xmax) & e["y1"].between(ymin, ymax))
    return (
        corner_inside
        | F.exists(ring_edges, lambda e: edge_meets_box(e, xmin, ymin, xmax, ymax))
        | point_in_ring(xmin, ymin, ring_edges)
    )


def is_box(polygons: str | Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """True when the geometry is one axis-parallel rectangle, that is, fills its bounding box with four edges."""
    ring_edges = outer_edges(polygons)
    straight = F.forall(ring_edges, lambda e: (e["x1"] == e["x2"]) != (e["y1"] == e["y2"]))
    on_frame = F.forall(
        ring_edges, lambda e: e["x1"].isin(xmin, xmax) & e["y1"].isin(ymin, ymax)
    )
    return (F.size(_col(polygons)) == 1) & (F.size(ring_edges) == 4) & straight & on_frame
