"""What the physical plans must and must not contain."""

import re

import pytest

from gridcompare.plans.catalog import all_queries

QUERIES = all_queries()
PYTHON_QUERIES = {"hull_centre"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_and_no_python(name, spark, small_dir):
    plan = plan_of(QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInPandas" in plan) == (name in PYTHON_QUERIES)


def test_filters_reach_the_scan_of_the_grouped_fact(spark, small_dir):
    plan = QUERIES["flagship"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "measurement_value" in line)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1)
    for column in ("species", "year", "measurement_unit", "gridtype", "codesource_area"):
        assert column in pushed


def test_area_box_reaches_the_scan_of_the_areas(spark, small_dir):
    plan = plan_of(QUERIES["areas_within_rect"](spark, small_dir))
    assert "GreaterThanOrEqual(xmin" in plan
    assert "polygons" not in plan.split("ReadSchema")[1]


def test_one_dataset_reads_one_folder(spark, small_dir):
    from gridcompare.operators.selection import Selection, filter_dimensions
    from gridcompare.sources.driver_tables import LEVEL1, DriverTables

    grouped = DriverTables(spark, small_dir).grouped()
    plan = plan_of(filter_dimensions(grouped, Selection(dataset=(LEVEL1,))))
    assert re.search(r"PartitionFilters: \[.*dataset", plan)


def test_area_filter_is_a_semi_join(spark, small_dir):
    plan = plan_of(QUERIES["facts_within"](spark, small_dir))
    assert "LeftSemi" in plan


def test_views_shuffle_only_their_own_keys(spark, small_dir):
    plan = plan_of(QUERIES["map_view"](spark, small_dir))
    assert not re.search(r"Exchange hashpartitioning\([^)]*species", plan)


def test_unused_columns_are_not_read(spark, small_dir):
    plan = plan_of(QUERIES["union_datasets"](spark, small_dir))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert schemas and not any("l_extendedprice" in s or "l_quantity" in s for s in schemas)


def test_a_chain_of_selections_keeps_its_size(spark, small_dir):
    from gridcompare.operators import selection as SE
    from gridcompare.plans.catalog import CHAIN
    from gridcompare.sources.driver_tables import DriverTables

    tables = DriverTables(spark, small_dir)
    result, sizes, scans = SE.apply_selection(tables.grouped(), tables.areas(), CHAIN[0]), [], []
    for selection in CHAIN[1:]:
        result, _ = SE.next_selection(tables.grouped(), tables.areas(), result, selection)
        for frame in (result.filtered, result.base, result.footprint):
            scans.append(plan_of(frame).split("== Initial Plan ==")[0].count("measurement_value:double"))
        sizes.append(len(result.filtered._jdf.queryExecution().analyzed().toString()))
    assert max(sizes) < 1.5 * sizes[0]
    assert max(scans) <= 2


def test_a_list_of_ten_thousand_values_is_a_filter_of_the_scan(spark, small_dir):
    from gridcompare.operators.selection import Selection, filter_dimensions
    from gridcompare.sources.driver_tables import LEVEL1, DriverTables

    grouped = DriverTables(spark, small_dir).grouped()
    short = filter_dimensions(grouped, Selection(dataset=(LEVEL1,), year=(1997,)))
    long = filter_dimensions(grouped, Selection(dataset=(LEVEL1, *map(str, range(10_000))), year=("1997", "x")))
    assert re.search(r"PartitionFilters: \[.*dataset", plan_of(long))
    assert sorted(map(tuple, long.collect()), key=repr) == sorted(map(tuple, short.collect()), key=repr)


def test_many_order_lines_are_dealt_once_to_tasks_by_their_number(spark, small_dir, monkeypatch):
    """By bytes a task would get millions of short lines, and memory for the sums of all of them."""
    from gridcompare.sources import driver_tables as D

    rows = spark.read.parquet(f"{small_dir}/lineitem.parquet").count()
    monkeypatch.setattr(D, "TASK_LINES", rows // 20)
    grouped = D.DriverTables(spark, small_dir).build_grouped()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grouped._jdf.queryExecution().sparkPlan().toString() + grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all("hashpartitioning(l_orderkey" in line for line in dealt)
    assert min(int(line.split(", REPARTITION_BY_NUM")[0].rsplit(" ", 1)[1].strip(")")) for line in dealt if ", REPARTITION_BY_NUM" in line) >= 20
    monkeypatch.setattr(D, "TASK_LINES", 1 << 19)
    assert D.DriverTables(spark, small_dir).build_grouped().exceptAll(grouped).isEmpty()
