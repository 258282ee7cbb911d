"""The area dimension: grid cells and nominal areas with geometry, bounding box and number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions import geometry as G
from gridcompare.functions import scalars as X
from gridcompare.functions.ordering import number_rows


def with_geometry(areas: DataFrame, wkt: str = "geom_wkt") -> DataFrame:
    """Add ``polygons`` and the bounding box read from a text column."""
    parsed = areas.withColumn("polygons", G.parse_polygons(wkt))
    return parsed.withColumns(G.bounding_box("polygons"))


def grid_areas(source: DataFrame) -> DataFrame:
    """Grid list ``code, GRIDTYPE, geom_wkt`` -> area rows with the grid type recoded."""
    return with_geometry(
        source.select(
            F.col("code").cast("string").alias("codesource_area"),
            X.recode_gridtype("GRIDTYPE").alias("gridtype"),
            "geom_wkt",
        )
    )


def used_by(areas: DataFrame, facts: DataFrame) -> DataFrame:
    """Areas that occur in the facts. Only distinct codes of the facts are shuffled."""
    return areas.join(facts.select("codesource_area").distinct(), "codesource_area", "left_semi")


def nominal_areas(source: DataFrame) -> DataFrame:
    """Nominal list ``code, geom_wkt`` -> area rows, each replaced by a 1-degree disc round its centroid."""
    centred = source.select(
        F.col("code").cast("string").alias("codesource_area"), G.centroid(G.parse_polygons("geom_wkt")).alias("centre")
    )
    discs = centred.select(
        "codesource_area",
        F.lit(S.NOMINAL_GRIDTYPE).alias("gridtype"),
        "centre",
        G.disc("centre.x", "centre.y").alias("polygons"),
    )
    return discs.select(
        "codesource_area",
        "gridtype",
        G.polygon_text(F.col("polygons")[0]).alias("geom_wkt"),
        "polygons",
        *[c.alias(n) for n, c in G.bounding_box("polygons").items()],
        "centre",
    )


def area_dimension(grid: DataFrame, nominal: DataFrame) -> DataFrame:
    """Grid and nominal areas together, not numbered."""
    return grid.unionByName(nominal.drop("centre"))


def numbered(areas: DataFrame) -> DataFrame:
    """Add ``ogc_fid``: the position in code order."""
    return number_rows(areas, ["codesource_area", "gridtype"], "ogc_fid").withColumn("ogc_fid", F.col("ogc_fid").cast("int"))


def repeated_codes(areas: DataFrame) -> DataFrame:
    """Codes listed more than once. Facts of such a code are repeated when they are joined, so this
    should be empty before a dimension is used."""
    return areas.groupBy("codesource_area").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def areas_of_facts(facts: DataFrame) -> DataFrame:
    """Distinct geometries of facts that carry their own geometry; the smallest id of each is kept. With
    ``with_geometry`` they serve as area dimension."""
    return (
        facts.where(F.col("gridtype").isNotNull() & F.col("geom_wkt").isNotNull())
        .groupBy("codesource_area", "gridtype", "geom_wkt")
        .agg(F.min("ogc_fid").alias("ogc_fid"))
    )


def geometry_as_text(areas: DataFrame) -> DataFrame:
    """Geometry column as text with its reference system, ready to be stored."""
    return areas.withColumn("geom", G.with_srid("geom_wkt"))


def first_part(areas: DataFrame) -> DataFrame:
    """First polygon of each geometry as text."""
    return areas.withColumn("geom_wkt", G.polygon_text(F.get(G.parse_polygons("geom_wkt"), F.lit(0))))


def explode_parts(areas: DataFrame) -> DataFrame:
    """One row per polygon, other columns repeated, parts counted from 1."""
    rest = [c for c in areas.columns if c != "geom_wkt"]
    parts = areas.select(*rest, F.posexplode(G.parse_polygons("geom_wkt")).alias("_pos", "_polygon"))
    return parts.select(*rest, (F.col("_pos") + 1).alias("part"), G.polygon_text(F.col("_polygon")).alias("geom_wkt"))


def footprint(areas: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Areas that make up the footprint of some facts (or of all areas), as rows with their bounding boxes."""
    areas = areas if facts is None else used_by(areas, facts)
    return areas.select("codesource_area", "polygons", "xmin", "ymin", "xmax", "ymax")


def footprint_text(footprint_areas: DataFrame) -> DataFrame:
    """``(codesource_area, footprint)``: the footprint as MULTIPOLYGON texts, one row per area, not dissolved."""
    body = F.array_join(F.transform("polygons", G.polygon_body), ",")
    return footprint_areas.select("codesource_area", F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")).alias("footprint"))
