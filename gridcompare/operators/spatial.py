"""Spatial predicates. Polygons meet the area dimension; facts are only ever joined by area code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcompare.functions import geometry as G
from gridcompare.functions.geometry import SelectionPolygon
from gridcompare.functions.hull import hull_centre
from gridcompare.functions.scalars import number_text

CELL_DEGREES = 5


def areas_inside(areas: DataFrame, polygon: str | SelectionPolygon) -> DataFrame:
    """Rows of the area dimension that lie wholly inside a polygon (its edge included).

    The bounding-box test is plain column comparisons, so on a stored dimension it prunes row groups.
    For a rectangle it is the exact answer; otherwise the few areas left are tested ring by ring.
    """
    polygon = SelectionPolygon.from_wkt(polygon) if isinstance(polygon, str) else polygon
    inside = areas.where(F.col("gridtype").isNotNull() & polygon.covers_box())
    return inside if polygon.is_rectangle else inside.where(polygon.covers("polygons"))


def areas_within(areas: DataFrame, polygon: str | SelectionPolygon) -> DataFrame:
    """Distinct codes of the areas inside a polygon."""
    return areas_inside(areas, polygon).select("codesource_area").distinct()


def facts_within(facts: DataFrame, inside: DataFrame) -> DataFrame:
    """Facts whose area is in the list. Spark broadcasts the list only while it is small enough.

    The list may repeat a code. It is not made distinct here: a semi join does not need that, and an
    aggregate on this side would keep adaptive execution from splitting the facts of a hot area.
    """
    codes = inside.select("codesource_area")
    return facts.where(F.col("codesource_area").isNotNull()).join(codes, "codesource_area", "left_semi")


# ---------------------------------------------------------------------------------------------
# Drawn features


def drawn_rectangles(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Rectangle of each drawn GeoJSON feature, read from its vertices 1, 2 and 3, as corners and text."""
    shape = F.from_json(feature, "geometry struct<coordinates:array<array<array<double>>>>")
    rest = [c for c in features.columns if c != feature]
    ring = features.select(*rest, F.get(shape["geometry"]["coordinates"], F.lit(0)).alias("_ring"))

    def coordinate(vertex: int, axis: int):
        return F.get(F.get("_ring", F.lit(vertex)), F.lit(axis))

    # As generated columns the corners are read once; a filter on them is not pushed below the JSON parser.
    corner = F.struct(
        coordinate(0, 0).alias("lng1"),
        coordinate(0, 1).alias("lat1"),
        coordinate(2, 0).alias("lng2"),
        coordinate(1, 1).alias("lat2"),
    )
    corners = ring.select(*rest, F.inline(F.array(corner)))
    names = ["lng1", "lat1", "lng2", "lat2"]
    texts = corners.withColumns({f"_{n}": number_text(n) for n in names})  # each is used more than once
    return texts.withColumn("wkt", G.rectangle_wkt(*[F.col(f"_{n}") for n in names])).drop(*[f"_{n}" for n in names])


def drawn_polygons(features: DataFrame, feature: str = "feature") -> DataFrame:
    """``polygons`` and ``wkt`` of each drawn GeoJSON feature: Polygon or MultiPolygon of any shape, holes included.
    NULL where the feature is neither, or a ring has under four points or none that ends where it began."""
    point = "array<double>"
    one = F.from_json(feature, f"geometry struct<type:string,coordinates:array<array<{point}>>>")["geometry"]
    many = F.from_json(feature, f"geometry struct<type:string,coordinates:array<array<array<{point}>>>>")["geometry"]
    kind = F.coalesce(F.col("_one.type"), F.lit("Polygon"))
    parts = F.when(kind == "Polygon", F.array(F.col("_one.coordinates"))).when(kind == "MultiPolygon", many["coordinates"])

    def as_point(p):
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
        """A generated column: computed once, however often it is used, and not again in each use."""
        return frame.select("*", F.explode(F.array(value)).alias(name))

    parsed = once(features, "_one", one)
    parsed = once(parsed, "_shape", F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, as_point))))
    closed = F.forall(F.flatten("_shape"), lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    shaped = once(parsed, "polygons", F.when(closed & (F.size(F.flatten("_shape")) > 0), F.col("_shape")))
    body = F.array_join(F.transform("polygons", G.polygon_body), ",")
    text = F.when(F.size("polygons") == 1, F.concat(F.lit("POLYGON "), body)).otherwise(F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")))
    return once(shaped, "wkt", text).drop(feature, "_one", "_shape")


def rectangle_centres(rectangles: DataFrame) -> DataFrame:
    return rectangles.withColumns(
        {"lon": (F.col("lng1") + F.col("lng2")) / 2, "lat": (F.col("lat1") + F.col("lat2")) / 2}
    )


def footprint_centre(footprint_areas: DataFrame) -> DataFrame:
    """Centroid of the convex hull of all outer rings."""
    points = footprint_areas.select(F.explode(G.outer_points("polygons")).alias("p")).select("p.x", "p.y")
    return hull_centre(points)


def _cells(low: str, high: str):
    return F.sequence(
        F.floor(F.col(low) / CELL_DEGREES).cast("int"), F.floor(F.col(high) / CELL_DEGREES).cast("int")
    )


def _by_cell(frame: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str) -> DataFrame:
    """One row per grid cell the box touches. A box of the whole globe touches 2,701 cells at most."""
    return frame.withColumn("cell_x", F.explode(_cells(xmin, xmax))).withColumn("cell_y", F.explode(_cells(ymin, ymax)))


def disjoint_rectangles(rectangles: DataFrame, areas: DataFrame) -> DataFrame:
    """Drawn rectangles that share no point with any area.

    Equal rectangles are tested once, and equal areas too; a grid cell needs no more than its box. Both sides are cut into grid cells, so the
    test is an equi-join; as a semi join it stops at the first area met and never emits pairs.
    """
    box = ["left", "bottom", "right", "top"]
    boxed = rectangles.withColumns(
        {
            "left": F.least("lng1", "lng2"),
            "bottom": F.least("lat1", "lat2"),
            "right": F.greatest("lng1", "lng2"),
            "top": F.greatest("lat1", "lat2"),
        }
    )
    distinct_boxes = _by_cell(boxed.select(*box).distinct(), *box)
    shapes = _by_cell(
        areas.select("polygons", "xmin", "ymin", "xmax", "ymax")
        .distinct()
        .select(
            G.outer_edges("polygons").alias("ring_edges"),
            G.is_box("polygons", *map(F.col, ("xmin", "ymin", "xmax", "ymax"))).alias("is_box"),
            "xmin", "ymin", "xmax", "ymax",
        ),
        "xmin", "ymin", "xmax", "ymax",
    )
    r, s = distinct_boxes.alias("r"), shapes.alias("s")
    overlap = (
        (F.col("s.xmin") <= F.col("r.right"))
        & (F.col("s.xmax") >= F.col("r.left"))
        & (F.col("s.ymin") <= F.col("r.top"))
        & (F.col("s.ymax") >= F.col("r.bottom"))
    )
    meets = F.col("s.is_box") | G.ring_touches_box(F.col("s.ring_edges"), *[F.col(f"r.{c}") for c in box])
    touching = r.join(
        s,
        (F.col("r.cell_x") == F.col("s.cell_x")) & (F.col("r.cell_y") == F.col("s.cell_y")) & overlap & meets,
        "left_semi",
    )
    return boxed.join(touching.select(*box), box, "left_anti").drop(*box)


def _edge_cells(shapes: DataFrame, name: str) -> DataFrame:
    """(key, edge, cell_x, cell_y): every edge of every ring once for each grid cell its box touches."""
    edges = shapes.select(F.col("_key"), F.explode(G.all_edges("polygons")).alias(name))
    ends = {axis: (F.least(f"{name}.{axis}1", f"{name}.{axis}2"), F.greatest(f"{name}.{axis}1", f"{name}.{axis}2")) for axis in "xy"}
    boxed = edges.withColumns({"_left": ends["x"][0], "_right": ends["x"][1], "_low": ends["y"][0], "_high": ends["y"][1]})
    return _by_cell(boxed, "_left", "_low", "_right", "_high").drop("_left", "_right", "_low", "_high")


def _point_cells(shapes: DataFrame) -> DataFrame:
    """(key, px, py, cell_x, cell_y): one corner of each polygon of each shape."""
    corners = shapes.select("_key", F.explode(G.outer_rings("polygons")).alias("_ring"))
    points = corners.select("_key", F.get("_ring", F.lit(0))["x"].alias("px"), F.get("_ring", F.lit(0))["y"].alias("py"))
    return points.withColumns({f"cell_{a}": F.floor(F.col(f"p{a}") / CELL_DEGREES).cast("int") for a in "xy"})


def _filled_cells(shapes: DataFrame) -> DataFrame:
    """(key, edges, cell_x, cell_y): every shape with all its edges once for each grid cell of its box."""
    filled = shapes.select("_key", G.all_edges("polygons").alias("_edges"), *[c.alias(n) for n, c in G.bounding_box("polygons").items()])
    return _by_cell(filled, "xmin", "ymin", "xmax", "ymax").drop("xmin", "ymin", "xmax", "ymax")


def disjoint_polygons(drawn: DataFrame, areas: DataFrame) -> DataFrame:
    """Drawn shapes (``polygons``, ``wkt``) of any form that share no point with any area; holes are no part of a shape.

    Two shapes share a point if edges of theirs meet, or if one holds a corner of a polygon of the other. Edges are
    dealt to grid cells and compared with the edges in the same cell only; corners with the shapes that reach their
    cell. All three tests are semi joins on the cell, which stop at the first match and which adaptive execution can
    split where a cell is hot. Equal shapes are tested once. A shape that is NULL is disjoint from everything.
    """
    shapes = drawn.where(F.col("polygons").isNotNull()).select(F.col("wkt").alias("_key"), "polygons").dropDuplicates(["_key"])
    others = areas.where(F.col("polygons").isNotNull()).select("polygons").distinct().withColumn("_key", F.lit(0))
    cell = ["cell_x", "cell_y"]

    def meeting(left: DataFrame, right: DataFrame, test) -> DataFrame:
        same = (F.col("l.cell_x") == F.col("r.cell_x")) & (F.col("l.cell_y") == F.col("r.cell_y"))
        return left.alias("l").join(right.drop("_key").alias("r"), same & test, "left_semi").select("_key")

    def holds(point: str, edges: str):
        return G.crosses_odd(F.col(f"{point}.px"), F.col(f"{point}.py"), F.col(f"{edges}._edges"))

    crossing = meeting(_edge_cells(shapes, "edge"), _edge_cells(others, "other"), G.edges_meet(F.col("l.edge"), F.col("r.other")))
    around = meeting(_filled_cells(shapes), _point_cells(others).select("_key", "px", "py", *cell).distinct(), holds("r", "l"))
    within = meeting(_point_cells(shapes), _filled_cells(others), holds("l", "r"))
    touching = crossing.unionByName(around).unionByName(within)
    return drawn.join(touching, drawn["wkt"] == touching["_key"], "left_anti")
