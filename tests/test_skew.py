"""A hot area: adaptive execution must be able to split it, and results stay whole."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.operators import areas as A
from gridcompare.operators import grouped as GR
from gridcompare.operators import spatial as SP

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """60,000 facts, one third of them in one area, and one hundred areas."""
    facts = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "a0").otherwise(F.concat(F.lit("a"), (F.col("id") % 100).cast("string"))).alias("codesource_area"),
        F.concat(F.lit("species"), F.col("id").cast("string")).alias("species"),
        F.lit(1.0).alias("measurement_value"),
        F.lit(2011).alias("year"),
        *[F.lit("x").alias(c) for c in S.GROUP_KEYS if c not in ("codesource_area", "species", "year")],
    )
    shapes = spark.range(100).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("codesource_area"),
        F.lit("others").alias("gridtype"),
        F.expr("concat('POLYGON ((', id, ' 0,', id + 1, ' 0,', id + 1, ' 1,', id, ' 1,', id, ' 0))')").alias("geom_wkt"),
    )
    return facts, A.with_geometry(shapes)


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_area_is_split_when_gridtype_is_joined(spark, hot):
    facts, areas = hot
    with small_limits(spark):
        rows, plan = executed(GR.grouped_fact(facts, areas))
    assert "SortMergeJoin(skew=true)" in plan
    assert sum(r["measurement_value"] for r in rows) == 60_000 and all(r["gridtype"] == "others" for r in rows)


def test_hot_area_is_split_when_facts_are_filtered(spark, hot):
    facts, areas = hot
    with small_limits(spark):
        rows, plan = executed(SP.facts_within(facts, SP.areas_inside(areas, "POLYGON ((0 0,50 0,50 1,0 1,0 0))")))
    assert "SortMergeJoin(skew=true)" in plan
    expected = sum(1 for i in range(60_000) if i % 3 == 0 or i % 100 < 50)
    assert len(rows) == expected


def test_hot_rectangle_is_split(spark, hot):
    """One third of the drawn rectangles are the same one."""
    _, areas = hot
    drawn = spark.range(0, 60_000, 1, 6).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, 200.0).otherwise((F.col("id") % 150).cast("double") + 0.25).alias("lng1"),
        F.lit(0.25).alias("lat1"),
    )
    drawn = drawn.withColumns({"lng2": F.col("lng1") + 0.5, "lat2": F.lit(0.75)})
    with small_limits(spark):
        rows, plan = executed(SP.disjoint_rectangles(drawn, areas))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == sum(1 for i in range(60_000) if i % 3 == 0 or i % 150 >= 100)
