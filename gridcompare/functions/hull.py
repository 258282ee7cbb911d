"""Convex hull as a mergeable aggregate: hull(A ∪ B) = hull(hull(A) ∪ hull(B))."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, collinear points left out."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    halves = []
    for ordered in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in ordered:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(p)
        halves.append(chain[:-1])
    return np.array(halves[0] + halves[1])


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners = np.empty((0, 2))
    for batch in batches:
        corners = _hull(np.vstack([corners, batch[["x", "y"]].to_numpy(dtype=float)]))
    if len(corners):
        yield pd.DataFrame(corners, columns=["x", "y"])


def hull_corners(points: DataFrame) -> DataFrame:
    """Corners of the convex hull of a frame of points ``(x, y)``.

    A hull corner is the lowest or highest point of its x, so a map-side combined min/max drops most
    points inside the JVM; each partition then sends only the corners of its own hull. What meets in
    the last task is corners of hulls, never the points.
    """
    extremes = points.where("x is not null and y is not null").groupBy("x").agg(
        F.min("y").alias("low"), F.max("y").alias("high")
    )
    candidates = extremes.select("x", F.explode(F.array("low", "high")).alias("y"))
    partial = candidates.mapInPandas(_partial_hulls, "x double, y double")
    return partial.repartition(1).mapInPandas(_partial_hulls, "x double, y double")


def _centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b[["x", "y"]].to_numpy(dtype=float) for b in batches]
    corners = _hull(np.vstack(parts)) if parts else np.empty((0, 2))
    if len(corners) == 0:
        return
    if len(corners) < 3:
        lon, lat = corners.mean(axis=0)
    else:
        origin = corners[0]
        a, b = corners - origin, np.roll(corners, -1, axis=0) - origin
        cross = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        lon, lat = origin + ((a + b) * cross[:, None]).sum(axis=0) / (3 * cross.sum())
    yield pd.DataFrame({"lon": [lon], "lat": [lat]})


def hull_centre(points: DataFrame) -> DataFrame:
    """Centroid of the convex hull as one row ``(lon, lat)``."""
    return hull_corners(points).mapInPandas(_centre, "lon double, lat double")
