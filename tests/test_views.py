import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcompare.operators import facets as FA
from gridcompare.operators import views as V
from gridcompare.operators.selection import Selection
from gridcompare.plans.catalog import all_queries

SERIES = "dataset string, year int, measurement_unit string, measurement_value double"


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        ("d1", 2011, "t", 10.9), ("d1", 2013, "t", 5.0), ("d2", 2011, "t", 3e9), ("d2", 2012, "no", 7.0),
        ("d3", 2012, "no", 0.4), ("d1", 2012, None, 2.0),
    ]
    return spark.createDataFrame(rows, SERIES)


def test_wide_series_cuts_fills_and_overflows_to_zero(series):
    wide = {(r["year"], r["measurement_unit"]): (r["d1"], r["d2"], r["d3"]) for r in V.series_wide(series, ["d1", "d2", "d3"]).collect()}
    assert wide[(2011, "t")] == (10, 0, 0)
    assert wide[(2013, "t")] == (5, 0, 0)
    assert wide[(2012, "no")] == (0, 7, 0)
    assert wide[(2012, None)] == (2, 0, 0)


def test_dense_series_cover_all_years_and_skip_empty_ones(series):
    dense = V.series_dense(series)
    got = {(r["series_name"], r["year"]): r["measurement_value"] for r in dense.collect()}
    assert {name for name, _ in got} == {"d1_t", "d2_no", "d1_NA"}
    assert len(got) == 3 * 3
    assert [got[("d1_t", y)] for y in (2011, 2012, 2013)] == [10, 0, 5]


def test_series_by_date(series):
    rows = {r["date"]: r for r in V.series_by_date(series, ["d1", "d2", "d3"]).collect()}
    first = rows[datetime.date(2011, 1, 1)]
    assert first["d1_t"] == 10.9 and first["d2_t"] == 3e9
    assert first["d2_no"] is None, "no row of that unit in this year"
    assert rows[datetime.date(2012, 1, 1)]["d3_no"] == 0.4
    assert rows[datetime.date(2012, 1, 1)]["d1_no"] is None, "a series without values stays empty"
    assert rows[datetime.date(2013, 1, 1)]["d2_t"] == 0.0


def test_view_totals_agree(spark, small_dir):
    queries = all_queries()
    totals = {
        name: queries[name](spark, small_dir).agg(F.sum("measurement_value")).first()[0]
        for name in ("filter_regroup", "map_view", "plot_view")
    }
    assert len(set(totals.values())) == 1


def test_grouped_total_equals_raw_total_of_rows_with_area(spark, small_dir):
    from gridcompare.sources.driver_tables import DriverTables

    tables = DriverTables(spark, small_dir)
    raw = tables.facts().where("codesource_area is not null").agg(F.sum("measurement_value")).first()[0]
    assert tables.grouped().agg(F.sum("measurement_value")).first()[0] == raw


def test_shares_sum_to_one(spark, small_dir):
    shares = all_queries()["gridtype_share"](spark, small_dir).groupBy("dataset").agg(F.sum("share").alias("s"))
    assert all(r["s"] == pytest.approx(1, abs=1e-5) for r in shares.collect())


TOTALS = "dataset string, gridtype string, measurement_unit string, measurement_value double, count long"


def test_share_of_an_empty_dataset_is_missing(spark):
    totals = spark.createDataFrame([("d", "a", "t", 0.0, 1), ("e", "a", "t", 2.0, 1), ("e", "b", "t", 6.0, 1)], TOTALS)
    got = {(r["dataset"], r["gridtype"]): r["share"] for r in V.gridtype_share(totals).collect()}
    assert got == {("d", "a"): None, ("e", "a"): 0.25, ("e", "b"): 0.75}


@pytest.mark.parametrize("numbers, units", [(True, {"no"}), (False, {"t"})])
def test_unit_switch(spark, numbers, units):
    two = spark.createDataFrame([("d", "a", "t", 1.0, 1), ("d", "a", "no", 2.0, 1)], TOTALS)
    assert {r["measurement_unit"] for r in V.one_unit(two, numbers).collect()} == units
    one = two.where("measurement_unit = 't'")
    assert {r["measurement_unit"] for r in V.one_unit(one, numbers).collect()} == {"t"}


def test_ratio_without_baseline_divides_by_one(spark):
    totals = spark.createDataFrame([("d1", 6.0), ("d2", 3.0)], "dataset string, measurement_value double")
    assert {r["dataset"]: r["ratio"] for r in V.ratio_to_baseline(totals, "absent").collect()} == {"d1": 6.0, "d2": 3.0}
    ratios = V.ratio_to_baseline(totals, "d2")
    assert {r["dataset"]: r["ratio"] for r in ratios.collect()} == {"d1": 2.0}
    assert {r["dataset"]: r["share"] for r in V.ratio_share(ratios).collect()} == {"d1": 1.0}


def test_totals_wide_names_and_gaps(spark):
    totals = spark.createDataFrame([("d1", "t", 2.0, 3), ("d2", "no", 5.0, 1)], "dataset string, measurement_unit string, measurement_value double, count long")
    wide = V.totals_wide(totals, ["no", "t"])
    assert wide.columns == ["dataset", "measurement_value_no", "measurement_value_t", "count_no", "count_t"]
    assert {tuple(r) for r in wide.collect()} == {("d1", 0.0, 2.0, 0, 3), ("d2", 5.0, 0.0, 1, 0)}


CELLS = "codesource_area string, dataset string, measurement_unit string, measurement_value double"


def test_deciles_with_ties(spark):
    values = [1.0] * 6 + [2.0, 3.0, 4.0, 50.0]
    cells = spark.createDataFrame([(str(i), "d", "t", v) for i, v in enumerate(values)], CELLS)
    breaks = np.quantile(values, [i / 10 for i in range(1, 10)])
    expected = {str(i): 1 + int(sum(b <= v for b in breaks)) for i, v in enumerate(values)}
    assert {r["codesource_area"]: r["decile"] for r in V.map_deciles(cells).collect()} == expected


def test_label_rounds_half_to_even(spark):
    cells = spark.createDataFrame([("a", "d", "t", 2.5), ("b", "d", "t", 3.5), ("c", "d", "t", 1200000.2)], CELLS)
    texts = {r["codesource_area"]: r["label"].split(": ")[1] for r in V.map_labels(cells).collect()}
    assert texts == {"a": "2 tonnes(t)", "b": "4 tonnes(t)", "c": "1200000 tonnes(t)"}


def test_few_gears_are_all_kept(spark):
    totals = spark.createDataFrame([("t", "01", 3.0), ("no", "01", 1.0), ("t", "02", 2.0)], "measurement_unit string, gear_type string, measurement_value double")
    assert {r[0] for r in V.top_gears_by_code(totals).collect()} == {"01", "02"}
    assert {tuple(r) for r in V.top_gears_by_total(totals, 1).collect()} == {("01", 4.0)}


# ---- facets


def codes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "code string")


def test_missing_label_shows_the_code(spark):
    codelist = spark.createDataFrame([("a", "Label a"), ("b", None)], "code string, label string")
    got = {r["code"]: r["label"] for r in FA.labelled(codes(spark, "a", "b", "c", None), codelist).collect()}
    assert got == {"a": "Label a", "b": "b", "c": "c", None: None}


def test_gears_fall_back_to_codes_when_the_list_repeats_one(spark):
    values = codes(spark, "01", "02")
    clean = spark.createDataFrame([("01", "One")], "code string, label string")
    assert {tuple(r) for r in FA.gear_facet(values, clean).select("code", "label").collect()} == {("01", "One"), ("02", "02")}
    repeated = clean.union(spark.createDataFrame([("01", "Uno")], clean.schema))
    assert {r["label"] for r in FA.gear_facet(values, repeated).collect()} == {"01", "02"}


def test_unknown_species_and_missing_definition(spark):
    species = spark.createDataFrame([("YFT", "Yellowfin", "Thunnus albacares"), ("UNK", None, None)], "code string, label string, taxon_scientific_name string")
    got = {r["code"]: r["label"] for r in FA.species_facet(codes(spark, "YFT", "UNK", "new"), species).collect()}
    assert got == {"YFT": "Thunnus albacares", "UNK": "Unknown (required for effort)", "new": "Unknown (required for effort)"}
    authorities = spark.createDataFrame([("IOTC", "IOTC", "Indian Ocean")], "code string, label string, definition string")
    shown = {r["label"] for r in FA.authority_facet(codes(spark, "IOTC", "XX"), authorities).collect()}
    assert shown == {"IOTC - Indian Ocean", "XX - NA"}


def test_labels_sort_as_in_english(spark):
    labels = spark.createDataFrame([("d", l, "shown", l) for l in ["b", "Z", "a", "é", "A", "B", "z"]], "dimension string, code string, label string, sort_label string")
    ordered = [r["code"] for r in sorted(FA.ordered_labels(labels).collect(), key=lambda r: r["pos"])]
    assert ordered == ["a", "A", "b", "B", "é", "z", "Z"]


def test_years_sort_as_numbers_and_skip_missing(spark):
    rows = [(y, g) for y, g in [(2011, "b"), (999, None), (None, "a")]]
    combos = spark.createDataFrame(rows, "year int, gridtype string")
    for name in ("dataset", "species", "gear_type", "measurement_unit", "source_authority", "fishing_fleet"):
        combos = combos.withColumn(name, F.lit("x"))
    got = {(r["dimension"], r["value"]): r["pos"] for r in FA.ordered_values(FA.facet_values(combos)).collect()}
    assert got == {("year", "999"): 1, ("year", "2011"): 2, ("gridtype", "a"): 1, ("gridtype", "b"): 2}


def test_dependent_values(spark, small_dir):
    from gridcompare.sources.driver_tables import DriverTables

    combos = DriverTables(spark, small_dir).combinations()
    every, some = FA.facet_values(combos), FA.dependent_values(combos, Selection(species=("PROMO",), year=(1997,)))
    assert some.subtract(every).isEmpty()
    assert {r["value"] for r in some.where("dimension in ('species', 'year')").collect()} == {"PROMO", "1997"}


def test_last_taxon_match_wins(spark):
    species = spark.createDataFrame([("a", "Thunnus"), ("b", "Thunnini"), ("c", None), ("d", "Nobody")], "code string, taxon_scientific_name string")
    matches = spark.createDataFrame([("Thunnus", 1, 10), ("Thunnus", 3, 30), ("Thunnus", 2, 20), ("Thunnini", 1, 99)], "name string, pos int, aphia_id int")
    assert {r["code"]: r["aphia_id"] for r in FA.taxon_ids(species, matches).collect()} == {"a": 30, "b": None, "c": None, "d": None}


def test_a_year_that_is_missing_is_one_of_the_years(spark):
    series = spark.createDataFrame([("d", 2011, "t", 5.0), ("d", None, "t", 7.0)], "dataset string, year int, measurement_unit string, measurement_value double")
    assert {(r["year"], r["measurement_value"]) for r in V.series_dense(series).collect()} == {(2011, 5), (None, 7)}


def test_a_single_unit_has_columns_without_suffix(spark):
    series = spark.createDataFrame([("d1", 2011, "HOOKS", 5.0), ("d2", 2012, "HOOKS", 0.0)], "dataset string, year int, measurement_unit string, measurement_value double")
    dated = V.series_by_date(series, ["d1", "d2"])
    assert dated.columns == ["date", "d1", "d2"]
    assert sorted((r["d1"], r["d2"]) for r in dated.collect()) == [(0.0, 0.0), (5.0, 0.0)]


def test_values_missing_from_a_pivot_list_are_an_error(spark):
    series = spark.createDataFrame([("d3", 2011, "t", 5.0)], "dataset string, year int, measurement_unit string, measurement_value double")
    with pytest.raises(ValueError, match="d3"):
        V.series_wide(series, ["d1", "d2"])
