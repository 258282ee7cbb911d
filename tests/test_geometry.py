import math
import random

import pytest
from pyspark.sql import functions as F

from gridcompare.functions import geometry as G
from gridcompare.functions.geometry import SelectionPolygon
from gridcompare.functions.hull import hull_centre, hull_corners
from gridcompare.functions.scalars import number_text
from gridcompare.operators import areas as A
from gridcompare.operators import spatial as SP


def square(x, y, w=1, h=1):
    return f"POLYGON (({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"


def areas_frame(spark, shapes):
    df = spark.createDataFrame(list(shapes.items()), "codesource_area string, geom_wkt string")
    return A.with_geometry(df.withColumn("gridtype", F.lit("others")))


def within(spark, shapes, polygon):
    return {r[0] for r in SP.areas_within(areas_frame(spark, shapes), polygon).collect()}


# ---- text


def test_parse_polygon_and_multipolygon_with_hole(spark):
    texts = [
        ("POLYGON ((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))",),
        ("SRID=4326;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5),(5.5 5.2,5.6 5.2,5.6 5.3,5.5 5.2)))",),
        ("POINT (1 2)",),
        (None,),
    ]
    df = spark.createDataFrame(texts, "w string").select(G.parse_polygons("w").alias("p"))
    shapes = [None if r["p"] is None else [[len(ring) for ring in polygon] for polygon in r["p"]] for r in df.collect()]
    assert shapes == [[[5, 5]], [[4], [4, 4]], None, None]


def test_text_round_trip(spark):
    text = "POLYGON ((0 0,10.5 0,10.5 -3.25,0 0),(1 -0.5,2 -0.5,2 -0.25,1 -0.5))"
    df = spark.createDataFrame([(text,)], "w string")
    assert df.select(G.polygon_text(G.parse_polygons("w")[0])).first()[0] == text


@pytest.mark.parametrize(
    "value, text", [(5.0, "5"), (0.0, "0"), (-0.0, "0"), (100.0, "100"), (-53.789063, "-53.789063"), (1e-7, "0.0000001")]
)
def test_number_text(spark, value, text):
    assert spark.range(1).select(number_text(F.lit(value))).first()[0] == text


# ---- measures


def test_centroid_subtracts_holes(spark):
    text = "POLYGON ((0 0,4 0,4 4,0 4,0 0),(0 0,2 0,2 4,0 4,0 0))"
    c = spark.createDataFrame([(text,)], "w string").select(G.centroid(G.parse_polygons("w")).alias("c")).first()["c"]
    assert (c["x"], c["y"]) == pytest.approx((3, 2))


def test_centroid_weighs_parts_by_area_and_ignores_direction(spark):
    text = "MULTIPOLYGON (((0 0,1 0,1 1,0 1,0 0)),((10 0,10 1,13 1,13 0,10 0)))"
    c = spark.createDataFrame([(text,)], "w string").select(G.centroid(G.parse_polygons("w")).alias("c")).first()["c"]
    assert (c["x"], c["y"]) == pytest.approx(((0.5 * 1 + 11.5 * 3) / 4, 0.5))


def test_disc_is_closed_and_round(spark):
    ring = spark.range(1).select(G.disc(F.lit(10.0), F.lit(-5.0))).first()[0][0][0]
    assert len(ring) == 121 and ring[0] == ring[-1]
    assert all(math.hypot(p["x"] - 10, p["y"] + 5) == pytest.approx(1, abs=1e-5) for p in ring)
    assert min(p["x"] for p in ring) == 9.0 and max(p["y"] for p in ring) == -4.0


# ---- selections


U_SHAPE = "POLYGON ((0 0,10 0,10 10,7 10,7 3,3 3,3 10,0 10,0 0))"


def test_areas_inside_a_notched_selection(spark):
    shapes = {
        "left arm": square(1, 5),
        "bridge across the notch": square(2, 5, 6, 1),
        "fills the notch": square(3, 3, 4, 7),
        "inside the notch": square(4, 5),
        "whole right arm": square(7, 0, 3, 10),
        "foot": square(0, 0, 10, 3),
        "touches the edge": square(0, 0),
        "outside": square(20, 20),
        "half out": square(9, 9, 2, 2),
        "diagonal over the notch": "POLYGON ((2 4,8 4,8 3.5,2 4))",
    }
    assert within(spark, shapes, U_SHAPE) == {"left arm", "whole right arm", "foot", "touches the edge"}


def test_ring_test_agrees_with_box_test_on_rectangles(spark):
    rng = random.Random(1)
    shapes = {str(i): square(rng.randint(-5, 10), rng.randint(-5, 10), rng.randint(1, 6), rng.randint(1, 6)) for i in range(60)}
    box = SelectionPolygon.from_wkt(square(0, 0, 9, 8))
    assert box.is_rectangle
    frame = areas_frame(spark, shapes)
    by_ring = {r[0] for r in frame.where(box.covers("polygons")).select("codesource_area").collect()}
    assert by_ring == within(spark, shapes, square(0, 0, 9, 8)) and by_ring


@pytest.mark.parametrize("seed", range(3))
def test_areas_inside_a_skyline_match_brute_force(spark, seed):
    """Selections under a random skyline: many notches, flush edges and shared corners."""
    rng = random.Random(seed)
    heights = [rng.randint(1, 6) for _ in range(8)]
    points = [(0, 0)]
    for i, h in enumerate(heights):
        points += [(i, h), (i + 1, h)]
    points += [(8, 0), (0, 0)]
    skyline = "POLYGON ((" + ",".join(f"{x} {y}" for x, y in points) + "))"
    boxes = {}
    for i in range(80):
        x, y = rng.randint(-1, 7), rng.randint(-1, 5)
        boxes[str(i)] = (x, y, x + rng.randint(1, 4), y + rng.randint(1, 3))
    inside = {
        name
        for name, (x0, y0, x1, y1) in boxes.items()
        if x0 >= 0 and x1 <= 8 and y0 >= 0 and y1 <= min(heights[x0:x1])
    }
    shapes = {name: square(x0, y0, x1 - x0, y1 - y0) for name, (x0, y0, x1, y1) in boxes.items()}
    assert within(spark, shapes, skyline) == inside
    assert inside


def test_bigger_rectangle_holds_what_the_smaller_one_holds(spark):
    shapes = {f"{x}/{y}": square(x, y) for x in range(0, 12, 2) for y in range(0, 12, 2)}
    assert within(spark, shapes, square(2, 2, 5, 5)) < within(spark, shapes, square(1, 1, 9, 9))


def test_an_area_without_gridtype_is_never_within(spark):
    frame = areas_frame(spark, {"a": square(1, 1)}).withColumn("gridtype", F.lit(None).cast("string"))
    assert SP.areas_within(frame, square(0, 0, 5, 5)).isEmpty()


@pytest.mark.parametrize(
    "bad", ["POINT (1 2)", "POLYGON ((0 0,1 1,2 0))", "POLYGON ((0 0,9 0,9 9,0 0),(1 1,2 1,2 2))", "MULTIPOLYGON ((0 0,1 0,1 1,0 0))", "POLYGON EMPTY"]
)
def test_selections_that_are_no_polygons_or_open_are_refused(bad):
    with pytest.raises(ValueError):
        SelectionPolygon.from_wkt(bad)


def test_slanted_four_corners_are_not_a_rectangle():
    assert not SelectionPolygon.from_wkt("POLYGON ((0 0,4 1,4 5,0 4,0 0))").is_rectangle
    assert not SelectionPolygon.from_wkt("POLYGON ((0 0,4 4,4 0,0 4,0 0))").is_rectangle


# ---- drawn rectangles against areas


def _inside(px, py, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def _segments_meet(a, b, c, d):
    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def on(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    s = [side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)]
    if s[0] != s[1] and s[2] != s[3]:
        return True
    return any(v == 0 and on(*w) for v, w in zip(s, [(a, b, c), (a, b, d), (c, d, a), (c, d, b)]))


def _touch(ring, box):
    x0, y0, x1, y1 = box
    frame = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    if any(_segments_meet(a, b, c, d) for a, b in zip(ring, ring[1:]) for c, d in zip(frame, frame[1:])):
        return True
    return _inside(x0, y0, ring) or (x0 <= ring[0][0] <= x1 and y0 <= ring[0][1] <= y1)


def test_disjoint_rectangles_match_brute_force(spark):
    rng = random.Random(4)
    rings = []
    for _ in range(12):
        x, y = rng.randint(-40, 40), rng.randint(-40, 40)
        ring = [(x, y), (x + rng.randint(1, 15), y + rng.randint(-3, 3)), (x + rng.randint(-3, 9), y + rng.randint(4, 15))]
        rings.append(ring + ring[:1])
    boxes = [(x, y, x + rng.randint(1, 12), y + rng.randint(1, 12)) for x, y in ((rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(150))]
    boxes += boxes[:5]
    shapes = {str(i): "POLYGON ((" + ",".join(f"{x} {y}" for x, y in ring) + "))" for i, ring in enumerate(rings)}
    drawn = spark.createDataFrame(
        [(i, float(x0), float(y0), float(x1), float(y1)) for i, (x0, y0, x1, y1) in enumerate(boxes)],
        "event_id long, lng1 double, lat1 double, lng2 double, lat2 double",
    )
    found = {r["event_id"] for r in SP.disjoint_rectangles(drawn, areas_frame(spark, shapes)).collect()}
    assert found == {i for i, box in enumerate(boxes) if not any(_touch(ring, box) for ring in rings)}
    assert 0 < len(found) < len(boxes)


def test_rectangle_from_three_vertices(spark):
    feature = '{"geometry":{"coordinates":[[[1.5,2],[1.5,8.25],[7,8.25],[7,2],[1.5,2]]]}}'
    rect = SP.drawn_rectangles(spark.createDataFrame([(1, feature)], "event_id int, feature string")).first()
    assert rect["wkt"] == "POLYGON ((1.5 8.25,7 8.25,7 2,1.5 2,1.5 8.25))"


# ---- hull


def test_hull_drops_inner_and_collinear_points(spark):
    points = [(x, y) for x in range(5) for y in range(5)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double").repartition(4)
    assert {(r["x"], r["y"]) for r in hull_corners(df).collect()} == {(0, 0), (4, 0), (0, 4), (4, 4)}


@pytest.mark.parametrize("points, centre", [([(0, 0), (6, 0), (0, 6)], (2, 2)), ([(1, 1), (3, 5)], (2, 3)), ([(2, 7)], (2, 7))])
def test_hull_centre(spark, points, centre):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double").repartition(3)
    row = hull_centre(df).first()
    assert (row["lon"], row["lat"]) == pytest.approx(centre)


def test_hull_centre_of_nothing(spark):
    assert hull_centre(spark.createDataFrame([], "x double, y double")).collect() == []


# ---- dimension


def test_a_footprint_is_one_text_per_area(spark):
    shapes = {f"{i:03d}": square(i, 0) for i in range(25)}
    rows = {r["codesource_area"]: r["footprint"] for r in A.footprint_text(A.footprint(areas_frame(spark, shapes))).collect()}
    assert len(rows) == 25
    assert rows["001"] == "MULTIPOLYGON (((1 0,2 0,2 1,1 1,1 0)))"


def test_repeated_codes_are_reported(spark):
    frame = areas_frame(spark, {"a": square(0, 0), "b": square(1, 1)})
    assert A.repeated_codes(frame).isEmpty()
    assert [r[0] for r in A.repeated_codes(frame.union(frame.where("codesource_area = 'b'"))).collect()] == ["b"]


HOLED = "POLYGON ((0 0,20 0,20 20,0 20,0 0),(5 5,5 15,15 15,15 5,5 5))"
PARTS = "MULTIPOLYGON (((0 0,10 0,10 10,0 10,0 0)),((10 0,20 0,20 10,10 10,10 0)),((30 0,40 0,40 10,30 10,30 0)))"
# Two parts that touch in two points and so enclose a gap.
GAP = "MULTIPOLYGON (((0 0,30 0,30 10,10 10,10 20,0 20,0 0)),((30 10,30 30,0 30,0 20,20 20,20 10,30 10)))"


def test_areas_inside_a_polygon_with_a_hole(spark):
    shapes = {
        "beside the hole": square(1, 1, 3, 3),
        "touches the hole": square(0, 5, 5, 5),
        "around the hole": square(1, 1, 18, 18),
        "is the hole": square(5, 5, 10, 10),
        "inside the hole": square(7, 7, 2, 2),
        "reaches into the hole": square(3, 3, 4, 4),
        "whole outer ring": square(0, 0, 20, 20),
        "outside": square(30, 30, 1, 1),
    }
    assert within(spark, shapes, HOLED) == {"beside the hole", "touches the hole"}


def test_areas_inside_several_polygons(spark):
    shapes = {
        "first": square(1, 1, 5, 5),
        "across the common edge": square(5, 2, 10, 5),
        "whole of two": square(0, 0, 20, 10),
        "third": square(30, 0, 10, 10),
        "between": square(22, 2, 3, 3),
        "across the gap": square(15, 2, 20, 3),
    }
    assert within(spark, shapes, PARTS) == {"first", "across the common edge", "whole of two", "third"}


def test_a_gap_enclosed_by_parts_is_outside(spark):
    shapes = {"around the gap": square(0, 0, 30, 30), "the gap": square(10, 10, 10, 10), "in the gap": square(12, 12, 2, 2), "corner": square(0, 0, 10, 10)}
    assert within(spark, shapes, GAP) == {"corner"}


def test_a_part_within_a_hole_counts(spark):
    island = HOLED.replace("POLYGON (", "MULTIPOLYGON ((") + ",((8 8,12 8,12 12,8 12,8 8)))"
    assert within(spark, {"island": square(8, 8, 4, 4), "lagoon": square(6, 6, 1, 1)}, island) == {"island"}
