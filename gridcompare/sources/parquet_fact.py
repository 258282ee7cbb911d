"""A stored fact with its own geometries as the source of facts and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcompare.operators import areas as A
from gridcompare.sources.stored import StoredTables


class ParquetFact(StoredTables):
    """Facts of one parquet table, in canonical columns, with ``gridtype``, ``geom_wkt`` and ``ogc_fid`` of each row's
    area (for example the table of ``jdbc.stored_fact`` with ``geom`` renamed)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def fact_inputs(self) -> list[str]:
        return [self.path]

    def area_inputs(self) -> list[str]:
        return [self.path]

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def facts(self) -> DataFrame:
        return self._rows().drop("gridtype", "geom_wkt", "ogc_fid")

    def build_areas(self) -> DataFrame:
        return A.with_geometry(A.areas_of_facts(self._rows()))
