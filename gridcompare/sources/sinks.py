"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare.operators.areas import geometry_as_text


def write_fact(fact: DataFrame, path: str) -> None:
    """The harmonised fact as parquet, one folder per dataset.

    ``rebalance`` gathers the rows of a dataset into files of even size; a dataset that holds most of the
    rows is split over many tasks.
    """
    fact.hint("rebalance", F.col("dataset")).write.partitionBy("dataset").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.csv(path, header=True)


def write_areas(areas: DataFrame, path: str) -> None:
    """Areas with the geometry as text, which any parquet reader understands."""
    drop = [c for c in ("polygons", "geom_wkt") if c in areas.columns]
    geometry_as_text(areas).drop(*drop).write.parquet(path)
