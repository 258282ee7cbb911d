import pytest
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.operators import areas as A
from gridcompare.operators import grouped as GR
from gridcompare.operators import selection as SE
from gridcompare.operators.selection import Selection

SQUARE = "POLYGON (({0} 0,{1} 0,{1} 1,{0} 1,{0} 0))"
GROUPED = (
    "codesource_area string, dataset string, source_authority string, species string, gear_type string, "
    "fishing_fleet string, year int, measurement_unit string, measurement_value double, gridtype string"
)


def row(area="a0", dataset="d1", authority="IOTC", species="YFT", gear="01.1", fleet="FR", year=2011, unit="t", value=1.0, gridtype="others"):
    return (area, dataset, authority, species, gear, fleet, year, unit, value, gridtype)


@pytest.fixture(scope="module")
def areas(spark):
    shapes = [(f"a{i}", SQUARE.format(i, i + 1)) for i in range(5)]
    frame = spark.createDataFrame(shapes, "codesource_area string, geom_wkt string")
    return A.with_geometry(frame.withColumn("gridtype", F.lit("others")))


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        row(),
        row(value=2.0, species="SKJ"),
        row(area="a1", year=2012, value=4.0),
        row(area="a2", dataset="d2", value=8.0),
        row(area="a3", fleet=None, value=16.0),
        row(area="zz", gridtype=None, value=32.0),
        row(area="a4", value=None, unit="no"),
    ]
    return spark.createDataFrame(rows, GROUPED)


def total(df):
    return df.agg(F.coalesce(F.sum("measurement_value"), F.lit(0.0))).first()[0]


def as_set(df):
    return {tuple(r) for r in df.select(*S.SELECTION_KEYS, "measurement_value").collect()}


EVERYTHING = Selection(
    dataset=("d1", "d2"), gridtype=("others",), species=("YFT", "SKJ"), year=(2011, 2012), gear_type=("01.1",),
    measurement_unit=("t", "no"), source_authority=("IOTC",), fishing_fleet=("FR",),
)


def test_lists_drop_missing_values_unless_they_hold_none(spark, facts):
    assert total(SE.filter_dimensions(facts, EVERYTHING)) == 15
    with_missing = EVERYTHING.with_values(fishing_fleet=("FR", None))
    assert total(SE.filter_dimensions(facts, with_missing)) == 31


def test_only_none_in_a_list(facts):
    assert total(SE.filter_dimensions(facts, Selection(fishing_fleet=(None,)))) == 16


def test_empty_list_keeps_nothing(facts):
    assert SE.filter_dimensions(facts, Selection(species=())).isEmpty()


def test_long_lists_and_text_values(facts):
    years, fleets = tuple(str(y) for y in range(1500, 2012)), ("FR", None, *map(str, range(300)))
    long = SE.filter_dimensions(facts, Selection(year=years, fishing_fleet=fleets))
    short = SE.filter_dimensions(facts, Selection(year=(2011,), fishing_fleet=("FR", None)))
    assert sorted(map(tuple, long.collect()), key=repr) == sorted(map(tuple, short.collect()), key=repr)
    assert not long.isEmpty()


def test_all_values_of_all_lists_are_a_reset(spark, facts):
    from gridcompare.operators import facets as FA

    values = FA.facet_values(facts)
    listed = {}
    for r in values.where("value is not null").collect():
        listed.setdefault(r["dimension"], []).append(r["value"])
    full = Selection(**{k: tuple(v) for k, v in listed.items()}, polygon=NO_AREA)
    assert SE.recognise_reset(full, values) == Selection.all(NO_AREA)
    fewer = full.with_values(species=("YFT",))
    assert SE.recognise_reset(fewer, values) == fewer
    assert SE.recognise_reset(full.with_values(year=None), values) == full.with_values(year=None)


def test_many_steps_end_like_a_fresh_selection(facts, areas):
    steps = [
        EVERYTHING,
        EVERYTHING.with_values(year=(2011,)),
        EVERYTHING.with_values(year=(2011,), species=("YFT",)),
        EVERYTHING.with_values(year=(2011,), species=("none",)),
        EVERYTHING.with_values(polygon=NO_AREA),
        EVERYTHING.with_values(dataset=("d1",)),
    ]
    result = SE.apply_selection(facts, areas, steps[0])
    statuses = []
    for step in steps[1:]:
        result, _ = SE.next_selection(facts, areas, result, step)
        statuses.append(result.status)
    assert statuses == [SE.APPLIED, SE.APPLIED, SE.DIMENSION_FALLBACK, SE.SPATIAL_FALLBACK, SE.APPLIED]
    assert as_set(result.filtered) == as_set(SE.selected(facts, areas, steps[-1]))


def test_rows_without_area_are_dropped(spark, facts):
    with_null = facts.unionByName(spark.createDataFrame([row(area=None, value=100.0)], GROUPED))
    assert total(SE.filter_dimensions(with_null, EVERYTHING)) == 15


def test_sum_of_missing_values_is_zero(facts):
    values = {r["codesource_area"]: r["measurement_value"] for r in SE.regroup(facts).collect()}
    assert values["a4"] == 0.0


def test_reset_keeps_rows_without_gridtype(facts, areas):
    kept = SE.selected(facts, areas, Selection.all())
    assert kept.count() == facts.count()
    assert kept.where("gridtype is null").count() == 1
    assert SE.selected(facts, areas, EVERYTHING).where("gridtype is null").isEmpty()


def test_polygon_is_applied_after_a_reset_too(facts, areas):
    polygon = "POLYGON ((0 0,2 0,2 1,0 1,0 0))"
    assert total(SE.selected(facts, areas, Selection.all(polygon))) == 7


def test_default_selection():
    default = Selection.default()
    assert default.year == tuple(range(2011, 2021)) and default.dataset is None and default.polygon
    assert default.without_polygon().polygon is None


def test_order_and_repetition_of_values_do_not_matter():
    assert Selection(year=(2011, 2012)).dimensions == Selection(year=(2012, 2011, 2012)).dimensions


def test_narrowing_and_added_values():
    wide, narrow = Selection(year=(1, 2, 3)), Selection(year=(2,), species=("YFT",))
    assert narrow.narrows(wide) and not wide.narrows(narrow)
    assert wide.added_values(narrow) == {"year": {1, 3}, "species": None}
    assert narrow.narrows(Selection.all()) and not Selection.all().narrows(narrow)


NO_AREA = "POLYGON ((50 50,60 50,60 60,50 60,50 50))"


def test_spatial_fallback(facts, areas):
    rows = SE.with_fallback(facts, areas, EVERYTHING.with_values(polygon=NO_AREA))
    assert {r["status"] for r in rows.collect()} == {SE.SPATIAL_FALLBACK}
    assert as_set(rows) == as_set(SE.selected(facts, areas, EVERYTHING))


def test_no_fallback_when_rows_are_inside(facts, areas):
    rows = SE.with_fallback(facts, areas, EVERYTHING.with_values(polygon=SQUARE.format(0, 1)), previous=facts)
    assert {r["status"] for r in rows.collect()} == {SE.APPLIED}
    assert total(rows) == 3


def test_a_reset_has_no_fallback(facts, areas):
    assert SE.with_fallback(facts, areas, Selection.all(NO_AREA), previous=facts).isEmpty()


def test_dimension_fallback_returns_the_previous_results(facts, areas):
    previous = SE.apply_selection(facts, areas, EVERYTHING.with_values(polygon=SQUARE.format(0, 1)))
    result = SE.apply_selection(facts, areas, EVERYTHING.with_values(species=("none",)), previous)
    assert {r["status"] for r in result.filtered.collect()} == {SE.DIMENSION_FALLBACK}
    assert as_set(result.filtered) == as_set(previous.filtered)
    assert result.base.count() == facts.count()
    assert {r[0] for r in result.footprint.collect()} == {r[0] for r in previous.footprint.collect()}


def test_footprint_holds_the_areas_of_the_lists_alone(facts, areas):
    result = SE.apply_selection(facts, areas, EVERYTHING.with_values(polygon=SQUARE.format(0, 1)))
    assert {r[0] for r in result.footprint.collect()} == {"a0", "a1", "a2", "a4"}
    assert {r["codesource_area"] for r in result.filtered.collect()} == {"a0"}


@pytest.mark.parametrize(
    "changed, way",
    [
        (EVERYTHING, "same"),
        (EVERYTHING.with_values(year=(2012, 2011)), "same"),
        (EVERYTHING.with_values(polygon=SQUARE.format(1, 3)), "polygon"),
        (EVERYTHING.with_values(year=(2011,)), "refine"),
        (EVERYTHING.with_values(year=(2011, 2013)), "scratch"),
        (EVERYTHING.with_values(fishing_fleet=None), "scratch"),
        (Selection.all(), "reset"),
    ],
)
def test_next_selection_equals_a_fresh_one(facts, areas, changed, way):
    previous = SE.apply_selection(facts, areas, EVERYTHING)
    result, used = SE.next_selection(facts, areas, previous, changed)
    assert used == way
    assert as_set(result.filtered) == as_set(SE.selected(facts, areas, changed))


def test_adding_a_value_never_lowers_the_total(facts, areas):
    one = SE.selected(facts, areas, EVERYTHING.with_values(dataset=("d1",)))
    assert total(one) <= total(SE.selected(facts, areas, EVERYTHING))


def test_require_rows(facts):
    assert SE.require_rows(facts) is facts
    with pytest.raises(SE.EmptySelection):
        SE.require_rows(facts.where("false"))


# ---- grouped fact


def test_grouped_fact(spark, areas):
    facts = spark.createDataFrame(
        [("a0", 1.0), ("a0", None), ("a1", None), (None, 5.0), ("zz", 2.0)], "codesource_area string, measurement_value double"
    )
    for name in S.GROUP_KEYS:
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(2011) if name == "year" else F.lit("x"))
    got = {r["codesource_area"]: (r["measurement_value"], r["gridtype"]) for r in GR.grouped_fact(facts, areas).collect()}
    assert got == {"a0": (1.0, "others"), "a1": (0.0, "others"), "zz": (2.0, None)}


def test_missing_group_keys_form_a_group(spark, areas):
    rows = [row(species=None, value=1.0), row(species=None, value=2.0), row(value=4.0)]
    grouped = GR.grouped_fact(spark.createDataFrame(rows, GROUPED).drop("gridtype"), areas)
    assert {r["species"]: r["measurement_value"] for r in grouped.collect()} == {None: 3.0, "YFT": 4.0}


def test_a_code_listed_twice_repeats_its_facts(spark, facts, areas):
    doubled = areas.unionByName(areas.where("codesource_area = 'a0'").withColumn("gridtype", F.lit("nominal")))
    grouped = GR.grouped_fact(facts.drop("gridtype"), doubled)
    assert {r["gridtype"] for r in grouped.where("codesource_area = 'a0'").collect()} == {"others", "nominal"}
