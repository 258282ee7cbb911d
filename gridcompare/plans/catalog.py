"""One named query per operator, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions import scalars as X
from gridcompare.functions.exact_sum import exact_sums
from gridcompare.operators import areas as A
from gridcompare.operators import facets as FA
from gridcompare.operators import grouped as GR
from gridcompare.operators import ingest as I
from gridcompare.operators import selection as SE
from gridcompare.operators import spatial as SP
from gridcompare.operators import views as V
from gridcompare.sources import driver_tables as D
from gridcompare.sources.driver_tables import DriverTables

BOX = ("xmin", "ymin", "xmax", "ymax")
UNITS = ("no", "t")
SELECTED = (*S.SELECTION_KEYS, "measurement_value")
LISTS_ONLY = D.DEFAULT.without_polygon()
TWO_UNITS = LISTS_ONLY.with_values(measurement_unit=UNITS)
ALL_UNITS = LISTS_ONLY.with_values(measurement_unit=None)

_QUERIES: dict[str, Callable[[DriverTables], DataFrame]] = {}


def _query(build: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[DriverTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(DriverTables(spark, sf_dir))

    return {name: bind(build) for name, build in _QUERIES.items()}


# ---------------------------------------------------------------------------------------------
# Ingest


@_query
def harmonise_layouts(t: DriverTables) -> DataFrame:
    return t.harmonised()


@_query
def union_datasets(t: DriverTables) -> DataFrame:
    return I.rows_per_dataset(t.harmonised())


@_query
def manifest_derive(t: DriverTables) -> DataFrame:
    return I.derive_manifest(t.manifest()).drop("source_filename")


@_query
def dataset_provenance(t: DriverTables) -> DataFrame:
    stored = I.derive_manifest(t.manifest()).select(F.concat(F.lit("/data/"), "newname").alias("filename"))
    return stored.withColumn("dataset", I.dataset_of_path("filename"))


def _enriched(t: DriverTables) -> DataFrame:
    return I.enrich_manifest(I.derive_manifest(t.manifest()), t.records())


@_query
def manifest_enrich(t: DriverTables) -> DataFrame:
    return _enriched(t).select("record_id", "title", "identifier")


@_query
def manifest_table(t: DriverTables) -> DataFrame:
    return I.manifest_table(_enriched(t))


@_query
def year_extract(t: DriverTables) -> DataFrame:
    return I.rows_per_year(t.raw_catch())


@_query
def unit_normalise(t: DriverTables) -> DataFrame:
    return I.unit_spellings(t.raw_catch())


@_query
def measure_cast(t: DriverTables) -> DataFrame:
    return I.measure_quality(t.raw_catch())


@_query
def drop_null_area(t: DriverTables) -> DataFrame:
    return I.rows_with_area(t.raw_catch())


# ---------------------------------------------------------------------------------------------
# Areas


@_query
def gridtype_recode(t: DriverTables) -> DataFrame:
    return t.area_grid_source().select("code", X.recode_gridtype("GRIDTYPE").alias("gridtype"))


@_query
def wkt_ring(t: DriverTables) -> DataFrame:
    parsed = A.with_geometry(t.area_sources())
    return parsed.select("codesource_area", F.size(F.col("polygons")[0][0]).alias("n_points"), *BOX)


@_query
def area_dim(t: DriverTables) -> DataFrame:
    return A.numbered(t.areas_unnumbered()).select("codesource_area", "gridtype", "ogc_fid", *BOX)


@_query
def areas_used(t: DriverTables) -> DataFrame:
    return A.used_by(A.grid_areas(t.area_grid_source()), t.grouped()).select("codesource_area", "gridtype")


@_query
def areas_from_facts(t: DriverTables) -> DataFrame:
    return A.areas_of_facts(t.facts_with_geometry())


@_query
def areas_from_facts_within(t: DriverTables) -> DataFrame:
    """Areas made from facts, as the dimension of a polygon selection."""
    return SP.areas_within(A.with_geometry(A.areas_of_facts(t.facts_with_geometry())), D.DEFAULT.polygon)


@_query
def nominal_disc(t: DriverTables) -> DataFrame:
    return A.nominal_areas(t.area_nominal_source()).select(
        "codesource_area",
        F.round("centre.x", 6).alias("cx"),
        F.round("centre.y", 6).alias("cy"),
        F.size(F.col("polygons")[0][0]).alias("n_points"),
    )


@_query
def geom_ewkt_text(t: DriverTables) -> DataFrame:
    return A.geometry_as_text(t.area_sources()).select("codesource_area", "geom")


@_query
def geom_first_part(t: DriverTables) -> DataFrame:
    return A.first_part(t.area_multi())


@_query
def geom_explode_parts(t: DriverTables) -> DataFrame:
    return A.explode_parts(t.area_multi())


# ---------------------------------------------------------------------------------------------
# Spatial


@_query
def areas_within_rect(t: DriverTables) -> DataFrame:
    return SP.areas_within(t.areas(), D.DEFAULT.polygon)


@_query
def areas_within_holed(t: DriverTables) -> DataFrame:
    """Areas inside two polygons, one of which has a hole."""
    return SP.areas_within(t.areas(), D.HOLED_POLYGONS)


@_query
def areas_within_polygon(t: DriverTables) -> DataFrame:
    return SP.areas_within(t.areas(), D.NOTCHED_POLYGON)


@_query
def facts_within(t: DriverTables) -> DataFrame:
    return SP.facts_within(t.grouped(), SP.areas_inside(t.areas(), D.DEFAULT.polygon)).select(*S.GROUPED_COLUMNS)


@_query
def geojson_rect_wkt(t: DriverTables) -> DataFrame:
    return SP.drawn_rectangles(t.drawn_features()).select("event_id", "wkt")


@_query
def selection_centre(t: DriverTables) -> DataFrame:
    return SP.rectangle_centres(SP.drawn_rectangles(t.drawn_features())).select("event_id", "lon", "lat")


@_query
def selection_disjoint(t: DriverTables) -> DataFrame:
    return SP.disjoint_rectangles(t.drawn(), t.areas()).select("event_id")


@_query
def footprint_text(t: DriverTables) -> DataFrame:
    kept = SE.filter_dimensions(t.grouped(), D.DEFAULT)
    return A.footprint_text(A.footprint(t.areas(), kept))


@_query
def hull_centre(t: DriverTables) -> DataFrame:
    centre = SP.footprint_centre(A.footprint(t.areas()))
    return centre.select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# ---------------------------------------------------------------------------------------------
# Grouped fact and selections


@_query
def grouped_fact(t: DriverTables) -> DataFrame:
    return t.build_grouped()


def _rows(t: DriverTables, selection: SE.Selection) -> DataFrame:
    """Rows of a selection as the views take them."""
    return SE.kept_rows(t.grouped(), t.areas(), selection)


@_query
def fact_by_parts(t: DriverTables) -> DataFrame:
    """The grouped fact stored one dataset at a time: two datasets first, then the third is added to them."""
    t.grouped_parts(D.DATASETS[:2])
    rows = t.grouped_parts(D.DATASETS)
    return exact_sums(rows, ["dataset"], "measurement_value", "total", n_rows=F.count(F.lit(1)))


@_query
def filter_eight_dims(t: DriverTables) -> DataFrame:
    return SE.filter_dimensions(t.grouped(), D.DEFAULT).select(*S.GROUPED_COLUMNS)


@_query
def filter_regroup(t: DriverTables) -> DataFrame:
    """From single observations, several of which make up one row of the result."""
    observations = t.facts().join(t.areas().select("codesource_area", "gridtype"), "codesource_area", "left")
    return SE.non_spatial(observations, t.areas(), D.DEFAULT).select(*SELECTED)


@_query
def filter_with_polygon(t: DriverTables) -> DataFrame:
    return SE.selected(t.grouped(), t.areas(), D.DEFAULT, summed=True).select(*SELECTED)


@_query
def fallback_spatial(t: DriverTables) -> DataFrame:
    return SE.with_fallback(t.grouped(), t.areas(), D.DEFAULT.with_values(polygon=D.EMPTY_RECTANGLE), summed=True)


@_query
def fallback_dims(t: DriverTables) -> DataFrame:
    previous = SE.selected(t.grouped(), t.areas(), D.DEFAULT, summed=True)
    return SE.with_fallback(t.grouped(), t.areas(), D.IMPOSSIBLE, previous, summed=True)


@_query
def refine_polygon_only(t: DriverTables) -> DataFrame:
    previous = SE.apply_selection(t.grouped(), t.areas(), D.DEFAULT, summed=True)
    result, _ = SE.next_selection(
        t.grouped(), t.areas(), previous, D.DEFAULT.with_values(polygon=D.SECOND_RECTANGLE), summed=True
    )
    return result.filtered.select(*SELECTED)


@_query
def refine_subset(t: DriverTables) -> DataFrame:
    """A narrowing answered from the kept rows of the selection before it."""
    grouped, areas, kept = t.grouped(), t.areas(), t.kept()
    previous = SE.apply_selection(grouped, areas, D.DEFAULT, None, True, kept).keep()
    result, _ = SE.next_selection(grouped, areas, previous, D.NARROW, True, kept)
    return result.filtered.select(*SELECTED)


@_query
def reset_all(t: DriverTables) -> DataFrame:
    everything = SE.selected(t.grouped(), t.areas(), SE.Selection.all(), summed=True)
    return everything.groupBy("gridtype").agg(F.count(F.lit(1)).alias("count"))


CHAIN = (
    D.DEFAULT,
    D.DEFAULT.with_values(year=(1996, 1997, 1998)),
    D.DEFAULT.with_values(year=(1996, 1997)),
    D.DEFAULT.with_values(year=("1997",)),
    D.DEFAULT.with_values(year=(1997,), species=("PROMO", "SMALL")),
    D.DEFAULT.with_values(year=(1997,), species=("PROMO",)),
    D.DEFAULT.with_values(year=(1997,), species=("NONE",)),
    D.DEFAULT.with_values(fishing_fleet=tuple(f"NATION_{i}" for i in range(14)), polygon=D.SECOND_RECTANGLE),
)


@_query
def refine_chain(t: DriverTables) -> DataFrame:
    """Five narrowings, one that keeps nothing, and a widening, each from the result before."""
    grouped, areas, kept = t.grouped(), t.areas(), t.kept()
    result = SE.apply_selection(grouped, areas, CHAIN[0], None, True, kept).keep()
    for selection in CHAIN[1:]:
        result, _ = SE.next_selection(grouped, areas, result, selection, True, kept)
    return result.filtered


@_query
def back_to_last_polygon(t: DriverTables) -> DataFrame:
    """A second polygon is drawn, the lists are narrowed, and the first polygon is asked for again."""
    grouped, areas, kept = t.grouped(), t.areas(), t.kept()
    result = SE.apply_selection(grouped, areas, D.DEFAULT, None, True, kept)
    for change in ({"polygon": D.SECOND_RECTANGLE}, {"year": D.NARROW.year}):
        result, _ = SE.next_selection(grouped, areas, result, result.selection.with_values(**change), True, kept)
    back, _ = SE.next_selection(grouped, areas, result, result.with_last_polygon(), True, kept)
    return back.filtered.select(*SELECTED)


@_query
def reset_listed(t: DriverTables) -> DataFrame:
    """All values of all lists are a reset."""
    listed: dict[str, list] = {}
    for value in t.values().where("value IS NOT NULL").collect():  # what a user can tick in eight lists
        listed.setdefault(value["dimension"], []).append(value["value"])
    everything = SE.Selection(**{name: tuple(values) for name, values in listed.items()})
    result = SE.apply_selection(t.grouped(), t.areas(), SE.recognise_reset(everything, t.values()))
    return result.filtered.groupBy("gridtype").agg(F.count(F.lit(1)).alias("count"))


@_query
def drawn_vs_footprint(t: DriverTables) -> DataFrame:
    """Drawn rectangles that miss the footprint of the default selection."""
    shown = SE.apply_selection(t.grouped(), t.areas(), D.DEFAULT, summed=True)
    return SP.disjoint_rectangles(t.drawn(), shown.footprint).select("event_id")


@_query
def drawings_disjoint(t: DriverTables) -> DataFrame:
    """Drawn frames that share no point with any area; an area inside the hole of a frame is no part of it."""
    return SP.disjoint_polygons(t.drawn_frames(), t.areas()).select("event_id")


@_query
def reset_polygon(t: DriverTables) -> DataFrame:
    return SE.selected(t.grouped(), t.areas(), D.DEFAULT.without_polygon(), summed=True).select(*SELECTED)


@_query
def values_added(t: DriverTables) -> DataFrame:
    new, old = FA.selection_values(t.grouped(), D.DEFAULT), FA.selection_values(t.grouped(), D.NARROW)
    return FA.added_values(new, old)


# ---------------------------------------------------------------------------------------------
# Facets


@_query
def facet_combinations(t: DriverTables) -> DataFrame:
    return GR.facet_combinations(t.grouped())


@_query
def facet_values(t: DriverTables) -> DataFrame:
    return FA.facet_values(t.combinations())


@_query
def facet_year_gridtype(t: DriverTables) -> DataFrame:
    return FA.ordered_values(t.values())


@_query
def facet_labels(t: DriverTables) -> DataFrame:
    return FA.facet_labels(t.values(), t.codelists()).drop("sort_label")


@_query
def dataset_facet(t: DriverTables) -> DataFrame:
    facet = FA.dataset_facet(FA.values_of(t.values(), "dataset"), _enriched(t))
    return facet.select("code", "label", "title", "identifier", "url")


@_query
def facet_order(t: DriverTables) -> DataFrame:
    labels = FA.facet_labels(t.values(), t.codelists())
    ordered = FA.ordered_labels(labels.where(~F.col("dimension").isin("year", "gridtype")))
    return ordered.drop("sort_label")


@_query
def facet_choosable(t: DriverTables) -> DataFrame:
    """What can be chosen in each list with two others chosen; years are given as text, one of them no number."""
    return FA.choosable_values(t.combinations(), SE.Selection(species=("PROMO",), year=("1997", "1998", "n/a"), measurement_unit=("t",)))


@_query
def facet_dependent(t: DriverTables) -> DataFrame:
    return FA.dependent_values(t.combinations(), SE.Selection(species=("PROMO",)))


@_query
def codelist_join(t: DriverTables) -> DataFrame:
    fleets = FA.values_of(t.values(), "fishing_fleet")
    return FA.labelled(fleets, t.codelists()["fishing_fleet"]).select("code", "label")


@_query
def species_facet(t: DriverTables) -> DataFrame:
    return FA.species_facet(FA.values_of(t.values(), "species"), t.codelists()["species"]).select("code", "label")


@_query
def gear_facet(t: DriverTables) -> DataFrame:
    return FA.gear_facet(FA.values_of(t.values(), "gear_type"), t.codelists()["gear_type"]).select("code", "label")


@_query
def authority_facet(t: DriverTables) -> DataFrame:
    authorities = FA.values_of(t.values(), "source_authority")
    return FA.authority_facet(authorities, t.codelists()["source_authority"]).select("code", "label")


@_query
def taxon_id_join(t: DriverTables) -> DataFrame:
    species = t.codelists()["species"]
    return FA.taxon_ids(species, t.taxon_matches()).select("code", "taxon_scientific_name", "aphia_id")


# ---------------------------------------------------------------------------------------------
# Views


def _map_areas(t: DriverTables) -> DataFrame:
    return t.areas().select("codesource_area", "gridtype", *BOX)


def _map_columns(view: DataFrame) -> DataFrame:
    return view.select("codesource_area", "dataset", "measurement_unit", "measurement_value", "gridtype", *BOX)


@_query
def flagship(t: DriverTables) -> DataFrame:
    """The default selection as a map: lists, polygon, sum per cell, area columns."""
    return _map_columns(V.map_view(_rows(t, D.DEFAULT), _map_areas(t)))


@_query
def map_view(t: DriverTables) -> DataFrame:
    return _map_columns(V.map_view(_rows(t, LISTS_ONLY), _map_areas(t)))


def _cells(t: DriverTables) -> DataFrame:
    return V.map_cells(_rows(t, LISTS_ONLY))


@_query
def map_layer_counts(t: DriverTables) -> DataFrame:
    return V.map_layer_counts(_cells(t))


@_query
def map_labels(t: DriverTables) -> DataFrame:
    return V.map_labels(_cells(t))


@_query
def map_deciles(t: DriverTables) -> DataFrame:
    return V.map_deciles(_cells(t)).drop("measurement_unit")


@_query
def plot_view(t: DriverTables) -> DataFrame:
    return V.plot_view(_rows(t, LISTS_ONLY))


def _series(t: DriverTables) -> DataFrame:
    return V.series_long(V.plot_view(_rows(t, ALL_UNITS)))


@_query
def series_long(t: DriverTables) -> DataFrame:
    return _series(t)


@_query
def series_wide(t: DriverTables) -> DataFrame:
    return V.series_wide(_series(t), D.DATASETS)


@_query
def series_dense(t: DriverTables) -> DataFrame:
    return V.series_dense(_series(t))


@_query
def series_dense_undated(t: DriverTables) -> DataFrame:
    """A series in which the rows of one year have lost their date."""
    rows = _rows(t, ALL_UNITS).withColumn("year", F.when(F.col("year") != 1998, F.col("year")))
    return V.series_dense(V.series_long(V.plot_view(rows)))


@_query
def series_date_one_unit(t: DriverTables) -> DataFrame:
    rows = _rows(t, LISTS_ONLY.with_values(measurement_unit=("HOOKS",)))
    return V.series_by_date(V.series_long(V.plot_view(rows)), D.DATASETS)


@_query
def series_date_merge(t: DriverTables) -> DataFrame:
    return V.series_by_date(_series(t), D.DATASETS)


def _plot(t: DriverTables) -> DataFrame:
    return V.plot_view(_rows(t, TWO_UNITS))


@_query
def gridtype_totals(t: DriverTables) -> DataFrame:
    return V.gridtype_totals(_plot(t))


@_query
def gridtype_share(t: DriverTables) -> DataFrame:
    return V.gridtype_share(V.gridtype_totals(_plot(t)))


@_query
def dataset_unit_totals(t: DriverTables) -> DataFrame:
    return V.dataset_unit_totals(_plot(t))


@_query
def dataset_totals(t: DriverTables) -> DataFrame:
    return V.dataset_totals(_plot(t))


@_query
def totals_wide(t: DriverTables) -> DataFrame:
    return V.totals_wide(V.dataset_unit_totals(_plot(t)), UNITS)


@_query
def bar_tons_only(t: DriverTables) -> DataFrame:
    return V.bar_tons_only(V.dataset_unit_totals(_plot(t)))


def _ratios(t: DriverTables) -> DataFrame:
    return V.ratio_to_baseline(V.dataset_totals(_plot(t)), D.LEVEL0)


@_query
def ratio_to_baseline(t: DriverTables) -> DataFrame:
    return _ratios(t).withColumn("ratio", F.round("ratio", 6))


@_query
def ratio_share(t: DriverTables) -> DataFrame:
    return V.ratio_share(_ratios(t)).withColumn("share", F.round("share", 6))


def _gear_series(t: DriverTables) -> DataFrame:
    return V.gear_species_series(t.grouped())


def _gears(t: DriverTables) -> DataFrame:
    return FA.values_of(t.values(), "gear_type").withColumnRenamed("code", "gear_type")


@_query
def gear_species_series(t: DriverTables) -> DataFrame:
    return _gear_series(t)


@_query
def gear_totals_sorted(t: DriverTables) -> DataFrame:
    return V.sorted_gear_totals(V.gear_totals(_gear_series(t)))


@_query
def gear_totals(t: DriverTables) -> DataFrame:
    return V.gear_totals(_gear_series(t))


@_query
def top_gears_by_code(t: DriverTables) -> DataFrame:
    return V.top_gears_by_code(_gears(t))


@_query
def top_gears_by_total(t: DriverTables) -> DataFrame:
    return V.top_gears_by_total(V.gear_totals(_gear_series(t)))


@_query
def top_gear_series(t: DriverTables) -> DataFrame:
    return V.series_of_gears(_gear_series(t), V.top_gears_by_code(_gears(t)))


@_query
def top_rows(t: DriverTables) -> DataFrame:
    return V.top_rows(SE.selected(t.grouped(), t.areas(), D.DEFAULT, summed=True)).select(*SELECTED, "rank")


def _priced(t: DriverTables) -> DataFrame:
    """Facts with fractional values: area, gear and discounted price."""
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = t.table("lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("codesource_area"), value.cast("double").alias("measurement_value"))
    parts = t.table("part").select("p_partkey", F.col("p_brand").alias("gear_type"), F.col("p_type").alias("species"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


@_query
def top_rows_fractional(t: DriverTables) -> DataFrame:
    """The ten largest sums of fractional values, per area and species."""
    sums = exact_sums(_priced(t), ["codesource_area", "species"], "measurement_value")
    return V.top_rows(sums).withColumn("measurement_value", F.round("measurement_value", 2))


@_query
def top_gears_fractional(t: DriverTables) -> DataFrame:
    return V.top_gears_by_total(_priced(t)).withColumn("measurement_value", F.round("measurement_value", 2))


@_query
def map_deciles_fractional(t: DriverTables) -> DataFrame:
    rows = _priced(t).select("codesource_area", F.col("species").alias("dataset"), F.lit("t").alias("measurement_unit"), "measurement_value")
    return V.map_deciles(V.map_cells(rows)).select("codesource_area", "dataset", "decile")
