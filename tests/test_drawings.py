"""Drawings of any shape against areas, compared with plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridcompare.operators import areas as A
from gridcompare.operators import spatial as SP


def text(rings):
    return "POLYGON (" + ",".join("(" + ",".join(f"{x} {y}" for x, y in ring) + ")" for ring in rings) + ")"


def sides(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]


def turn(a, b, c):
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def cross(p, q):
    (a, b), (c, d) = p, q
    apart = any(max(s[0][k], s[1][k]) < min(t[0][k], t[1][k]) for s, t in ((p, q), (q, p)) for k in (0, 1))
    return not apart and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def holds(rings, point):
    x, y = point
    inside = False
    for (x1, y1), (x2, y2) in sides(rings):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def touch(one, two):
    return any(cross(p, q) for p in sides(one) for q in sides(two)) or holds(one, two[0][0]) or holds(two, one[0][0])


def shape(rng, size, hole):
    x, y = rng.randint(-80, 80), rng.randint(-60, 60)
    w, h = rng.randint(2, size), rng.randint(2, size)
    outer = [(x, y), (x + w, y), (x + w, y + h), (x + w // 2, y + rng.randint(1, h)), (x, y + h), (x, y)]
    if hole and w > 6 and h > 6:
        outer = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        return [outer, [(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1), (x + 1, y + 1)]]
    return [outer]


def frames(spark, drawings, areas):
    features = [(i, json.dumps({"geometry": {"type": "Polygon", "coordinates": rings}})) for i, rings in enumerate(drawings)]
    drawn = SP.drawn_polygons(spark.createDataFrame(features, "id long, feature string"))
    dimension = spark.createDataFrame([(str(i), text(r)) for i, r in enumerate(areas)], "codesource_area string, geom_wkt string")
    return drawn, A.with_geometry(dimension)


@pytest.mark.parametrize("seed", range(2))
def test_disjoint_drawings_are_those_of_plain_python(spark, seed):
    rng = random.Random(seed)
    drawings = [shape(rng, 40, i % 2) for i in range(40)]
    areas = [shape(rng, 12, i % 5 == 0) for i in range(25)]
    drawn, dimension = frames(spark, drawings, areas)
    found = {r.id for r in SP.disjoint_polygons(drawn, dimension).collect()}
    assert found == {i for i, d in enumerate(drawings) if not any(touch(d, a) for a in areas)}
    assert 0 < len(found) < len(drawings)


def test_holes_repeats_missing_shapes_and_no_areas(spark):
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    ring = [box(0, 0, 30), box(10, 10, 10)]
    drawn, areas = frames(spark, [ring, ring, [box(40, 40, 2)], [[(0, 0), (1, 1)]]], [[box(12, 12, 3)]])
    assert {r.id for r in SP.disjoint_polygons(drawn, areas).collect()} == {0, 1, 2, 3}
    drawn, areas = frames(spark, [ring, [box(1, 1, 2)]], [[box(10, 12, 3)], [box(-5, -5, 50)]])
    assert {r.id for r in SP.disjoint_polygons(drawn, areas).collect()} == set()
    assert SP.disjoint_polygons(drawn, areas.limit(0)).count() == 2


def test_multipolygons_and_other_features(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        {"geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(features)], "id long, feature string")
    texts = {r.id: r.wkt for r in SP.drawn_polygons(df).collect()}
    assert texts == {0: "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((0 0,1 0,1 1,0 0)))", 1: None, 2: None}


def test_a_hot_cell_is_split(spark):
    """All drawings in one cell: the semi join on the cell is an equi-join that adaptive execution can split."""
    drawn, areas = frames(spark, [[[(1, 1), (2, 1), (2, 2), (1, 1)]]], [[[(3, 3), (4, 3), (4, 4), (3, 3)]]])
    many = spark.range(5000).join(drawn.drop("id")).withColumn("wkt", F.concat("wkt", F.col("id").cast("string")))
    assert SP.disjoint_polygons(many, areas).count() == 5000
    plan = SP.disjoint_polygons(many, areas)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "cell_x" in plan


def test_a_drawing_is_parsed_once_however_often_it_is_used(spark):
    """Inlined in each of its uses, the parser would run dozens of times for every row."""
    features = spark.createDataFrame([(1, "{}")], "id long, feature string")
    plan = SP.drawn_polygons(features)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # as one polygon, and as several
