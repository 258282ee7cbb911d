"""Pre-aggregation of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions.exact_sum import exact_sums


def grouped_fact(facts: DataFrame, areas: DataFrame) -> DataFrame:
    """Facts with an area, summed to the grouping keys, with the grid type of the area.

    The join comes after the sum, so it sees one row per group. Areas that are not in the dimension
    keep a NULL grid type.
    """
    summed = exact_sums(facts.where(F.col("codesource_area").isNotNull()), S.GROUP_KEYS, "measurement_value")
    return summed.join(areas.select("codesource_area", "gridtype"), "codesource_area", "left").select(*S.GROUPED_COLUMNS)


def facet_combinations(grouped: DataFrame) -> DataFrame:
    """Existing combinations of the eight dimensions with their number of rows."""
    return grouped.groupBy(*S.DIMENSIONS).agg(F.count(F.lit(1)).alias("count"))
