"""From files on disk to selections and views."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridcompare.operators import facets as FA
from gridcompare.operators import views as V
from gridcompare.operators.selection import SPATIAL_FALLBACK, Selection
from gridcompare.sources import stored
from gridcompare.sources.published import Inputs, PublishedFiles

HEADER_A = "source_authority,fishing_fleet,time_start,time_end,geographic_identifier,gear_type,species,fishing_mode,measurement_unit,measurement_value\n"
HEADER_B = "source_authority,flag,time_start,time_end,geographic_identifier,gear,species,schooltype_label,catchunit,value\n"
ROWS_A = "IOTC,EUFRA,2012-01-01,2012-01-31,100,01.1,YFT,FS,MT,2.5\nIOTC,EUFRA,2012-02-01,2012-02-28,100,01.1,YFT,LS,t,1.5\nIOTC,EUESP,2012-01-01,2012-01-31,N1,01.2,YFT,FS,NO,7\n"
ROWS_B = "ICCAT,EUESP,2013-01-01,2013-01-31,200,01.1,YFT,FS,Tons,4\nICCAT,EUESP,2013-01-01,2013-01-31,NA,01.1,YFT,FS,Tons,100\nICCAT,EUESP,2013-01-01,2013-01-31,999,01.1,YFT,FS,Tons,bad\n"
ROW_C = "IOTC,FRA,1990-01-01,1990-01-31,100,09,SKJ,FS,t,1\n"
ROW_D = "IOTC,FRA,1991-01-01,1991-01-31,100,09,SKJ,FS,Tons,2\n"


@pytest.fixture
def published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "storage_root", lambda spark: str(tmp_path / "store"))
    stored.forget_tables()
    data = tmp_path / "data"
    data.mkdir()
    (tmp_path / "list.csv").write_text(
        "DOI,Filename\n10.5281/zenodo.11,catch_a.csv\n10.5281/zenodo.22,catch_b.zip\n"
        "10.5281/zenodo.33,catch c.csv\n10.5281/zenodo.44,catch_d.qs\n"
    )
    (tmp_path / "records.csv").write_text("record_id,title,identifier\n11,urn:Catch A,urn:x:1\n")
    (data / "catch_a_11.csv").write_text(HEADER_A + ROWS_A)
    (data / "catch c_33.csv").write_text(HEADER_A + ROW_C)
    columns = HEADER_A.strip().split(",")
    spark.createDataFrame([tuple(ROW_D.strip().split(","))], columns).write.parquet(str(data / "catch_d_44.parquet"))
    with zipfile.ZipFile(data / "catch_b.zip", "w") as archive:
        archive.writestr("catch_b.csv", HEADER_B + ROWS_B)
    (tmp_path / "grid.csv").write_text(
        "code,GRIDTYPE,geom_wkt\n"
        '100,1deg_x_1deg,"POLYGON ((0 0,1 0,1 1,0 1,0 0))"\n'
        '200,5deg_x_5deg,"POLYGON ((40 10,45 10,45 15,40 15,40 10))"\n'
        '300,5deg_x_5deg,"POLYGON ((50 10,55 10,55 15,50 15,50 10))"\n'
    )
    (tmp_path / "nominal.csv").write_text('code,geom_wkt\nN1,"POLYGON ((0 0,6 0,0 6,0 0))"\nN2,"POLYGON ((9 0,15 0,9 6,9 0))"\n')
    (tmp_path / "fleets.csv").write_text("code,label\nEUFRA,France\nEUESP,\n")
    yield PublishedFiles(
        spark,
        Inputs(
            str(tmp_path / "list.csv"), str(data), str(tmp_path / "grid.csv"), str(tmp_path / "nominal.csv"),
            {"fishing_fleet": str(tmp_path / "fleets.csv")}, str(tmp_path / "records.csv"),
        ),
    )
    stored.forget_tables()


def test_facts_of_two_layouts(published):
    facts = published.facts()
    rows = {(r["dataset"], r["codesource_area"], r["measurement_unit"], r["measurement_value"], r["year"]) for r in facts.collect()}
    assert rows == {
        ("catch_a_11", "100", "t", 2.5, 2012), ("catch_a_11", "100", "t", 1.5, 2012), ("catch_a_11", "N1", "no", 7.0, 2012),
        ("catch_b_22", "200", "t", 4.0, 2013), ("catch_b_22", None, "t", 100.0, 2013), ("catch_b_22", "999", "t", None, 2013),
        ("catch c_33", "100", "t", 1.0, 1990), ("catch_d_44", "100", "t", 2.0, 1991),
    }


def test_files_of_one_layout_are_one_scan(published):
    plan = published.harmonised()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("] csv") == 1


def test_areas_of_the_facts_and_all_nominal_ones(published):
    areas = {r["codesource_area"]: (r["gridtype"], r["ogc_fid"]) for r in published.areas().collect()}
    assert areas == {"100": ("1deg_x_1deg", 1), "200": ("5deg_x_5deg", 2), "N1": ("nominal", 3), "N2": ("nominal", 4)}


def test_grouped_fact_and_facets(published):
    recent = published.grouped().where("year > 2000").collect()
    grouped = {r["codesource_area"]: (r["measurement_value"], r["gridtype"]) for r in recent}
    assert grouped == {"100": (4.0, "1deg_x_1deg"), "N1": (7.0, "nominal"), "200": (4.0, "5deg_x_5deg"), "999": (0.0, None)}
    labels = {(r["dimension"], r["code"]): r["label"] for r in published.facets().collect()}
    assert labels["fishing_fleet", "EUFRA"] == "France" and labels["fishing_fleet", "EUESP"] == "EUESP"
    assert labels["dataset", "catch_b_22"] == "catch_b_22"
    assert ("gridtype", None) not in labels


def test_selections_step_by_step(published):
    first = published.default().keep()
    assert [(r["codesource_area"], r["measurement_value"], r["status"]) for r in first.filtered.collect()] == [("100", 4.0, "applied")]
    moved = published.select(first.selection.with_values(polygon="POLYGON ((39 9,46 9,46 16,39 16,39 9))"), first)
    assert moved.filtered.isEmpty()
    wider = published.select(
        first.selection.with_values(gridtype=("1deg_x_1deg", "5deg_x_5deg", "nominal"), measurement_unit=("t", "no")), first
    )
    totals = {r["dataset"]: r["measurement_value"] for r in V.dataset_totals(V.plot_view(wider.filtered)).collect()}
    assert totals == {"catch_a_11": 11.0, "catch_b_22": 4.0}
    nowhere = published.select(wider.selection.with_values(year=(2012,), polygon="POLYGON ((90 80,91 80,91 81,90 81,90 80))"), wider)
    assert {r["status"] for r in nowhere.filtered.collect()} == {SPATIAL_FALLBACK}
    everything = published.select(Selection.all(), wider)
    assert everything.filtered.agg(F.sum("measurement_value")).first()[0] == 18.0


def test_the_default_is_stored_and_read(published):
    first = published.default()
    assert "default_selection" in first.filtered._jdf.queryExecution().optimizedPlan().toString() or first.filtered.inputFiles()
    assert [tuple(r) for r in published.default().filtered.collect()] == [tuple(r) for r in first.filtered.collect()]


def test_a_drawing_that_misses_the_footprint_selects_nothing(published):
    ring = lambda x, y: f'{{"geometry":{{"coordinates":[[[{x},{y}],[{x},{y + 2}],[{x + 2},{y + 2}],[{x + 2},{y}],[{x},{y}]]]}}}}'
    first = published.default()
    assert published.draw(ring(100, 60), first) is None
    drawn = published.draw(ring(-1, -1), first)
    assert {r["codesource_area"] for r in drawn.filtered.collect()} == {"100"}


def test_facets_have_places(published):
    rows = [r for r in published.facets().collect() if r["dimension"] == "fishing_fleet"]
    assert [r["code"] for r in sorted(rows, key=lambda r: r["pos"])] == ["EUESP", "FRA", "EUFRA"]
    assert published.datasets().count() == 4


def test_parquet_fact_from_file_to_map(spark, published, tmp_path):
    from gridcompare.operators.selection import apply_selection
    from gridcompare.sources.parquet_fact import ParquetFact

    shapes = published.areas().select("codesource_area", "gridtype", "geom_wkt", "ogc_fid")
    published.facts().join(shapes, "codesource_area", "left").write.parquet(str(tmp_path / "fact"))
    fact = ParquetFact(spark, str(tmp_path / "fact"))
    result = apply_selection(fact.grouped(), fact.areas(), Selection(polygon="POLYGON ((-1 -1,4 -1,4 4,-1 4,-1 -1))"))
    cells = V.map_view(V.map_cells(result.filtered), fact.areas())
    assert {(r["codesource_area"], r["xmin"]) for r in cells.collect()} == {("100", 0.0), ("N1", 1.0)}


def test_manifest_has_titles(published):
    titles = {r["code"]: (r["title"], r["identifier"]) for r in published.manifest().collect()}
    assert titles == {
        "catch_a_11": ("Catch A", "x:1"), "catch_b_22": ("", ""), "catch c_33": ("", ""), "catch_d_44": ("", ""),
    }


def test_datasets_are_shown_with_their_titles(published):
    shown = FA.dataset_facet(FA.values_of(published.values(), "dataset"), published.manifest())
    assert {r["code"]: (r["label"], r["title"]) for r in shown.where("code like '%_11' or code like '%_22'").collect()} == {
        "catch_a_11": ("catch_a_11", "Catch A"), "catch_b_22": ("catch_b_22", ""),
    }


# ---- changes of the files


def files_read(frame):
    return {name.rsplit("/", 1)[-1] for name in frame.inputFiles()}


@pytest.fixture
def builds(monkeypatch):
    """Which datasets each later build of a table takes."""
    seen = []
    build = PublishedFiles.harmonised

    def watched(self, datasets=None):
        seen.append(sorted(datasets))
        return build(self, datasets)

    monkeypatch.setattr(PublishedFiles, "harmonised", watched)
    return seen


def again(published):
    stored.forget_tables()
    return PublishedFiles(published.spark, published.inputs)


def totals_by_dataset(published):
    return {(r["dataset"], r["codesource_area"], r["year"]): r["measurement_value"] for r in published.grouped().collect()}


def test_an_added_file_is_the_only_one_read(published, builds, tmp_path):
    before = totals_by_dataset(published)
    facets = published.values().count()
    folders = set(published.facts().inputFiles())
    (tmp_path / "data" / "catch_e_55.csv").write_text(HEADER_A + "IOTC,FRA,2001-01-01,2001-01-31,300,09,BET,FS,t,8\n")
    with open(tmp_path / "list.csv", "a") as manifest:
        manifest.write("10.5281/zenodo.55,catch_e.csv\n")
    later = again(published)
    assert totals_by_dataset(later) == {**before, ("catch_e_55", "300", 2001): 8.0}
    assert builds[1:] == [["catch_e_55"]]  # the first build took all
    assert folders < set(later.facts().inputFiles())
    assert later.values().count() == facets + 3  # a dataset, a year and a species
    assert {r["codesource_area"] for r in later.areas().collect()} == {"100", "200", "300", "N1", "N2"}
    assert {r["gridtype"] for r in later.grouped().where("codesource_area = '300'").collect()} == {"5deg_x_5deg"}


def test_a_removed_file_is_no_longer_read(published, builds, tmp_path):
    before = totals_by_dataset(published)
    text = (tmp_path / "list.csv").read_text()
    (tmp_path / "list.csv").write_text(text.replace("10.5281/zenodo.22,catch_b.zip\n", ""))
    later = again(published)
    assert totals_by_dataset(later) == {k: v for k, v in before.items() if k[0] != "catch_b_22"}
    assert len(builds) == 1
    assert {r["codesource_area"] for r in later.areas().collect()} == {"100", "N1", "N2"}


def test_a_rewritten_file_is_read_again(published, builds, tmp_path):
    before = totals_by_dataset(published)
    (tmp_path / "data" / "catch c_33.csv").write_text(HEADER_A + ROW_C.replace(",1\n", ",42\n"))
    later = again(published)
    assert totals_by_dataset(later) == {**before, ("catch c_33", "100", 1990): 42.0}
    assert builds[1:] == [["catch c_33"]]


def test_a_dataset_without_rows_is_stored_too(published, builds, tmp_path):
    (tmp_path / "data" / "catch c_33.csv").write_text(HEADER_A)
    assert {k[0] for k in totals_by_dataset(published)} == {"catch_a_11", "catch_b_22", "catch_d_44"}
    assert totals_by_dataset(again(published)) and len(builds) == 1


# ---- kept selections


def test_a_narrowing_reads_the_kept_rows_and_not_the_fact(published):
    wide = published.select(Selection(species=("YFT",), gear_type=("01.1", "01.2")))
    fact = set(published.grouped().inputFiles())
    narrow = published.select(Selection(species=("YFT",), gear_type=("01.1",), year=("2012",)), wide)
    assert not fact & set(narrow.filtered.inputFiles())
    assert not fact & set(wide.base.inputFiles())
    assert {(r["codesource_area"], r["measurement_value"]) for r in narrow.filtered.collect()} == {("100", 4.0)}
    assert not fact & set(narrow.footprint.inputFiles())
    other = published.select(Selection(species=("SKJ",)), narrow)
    assert {r["measurement_value"] for r in other.filtered.collect()} == {1.0, 2.0}


def test_the_smallest_kept_result_answers(published):
    kept = published.kept()
    for lists in (Selection(species=("YFT", "SKJ")), Selection(species=("YFT",), year=(2012, 2013)), Selection(year=(2012,))):
        kept.keep(lists)
    rows = lambda lists: kept.source(lists).count()
    assert rows(Selection(species=("YFT",), year=("2012",))) == 2  # of year 2012 alone
    assert rows(Selection(species=("YFT",))) == kept.facts.count()
    assert kept.source(Selection(gear_type=("09",))) is None and kept.source(Selection.all()) is None


def test_kept_results_do_not_outlive_their_inputs(published, tmp_path):
    lists = Selection(year=(1990,))
    assert [r["measurement_value"] for r in published.select(lists).filtered.collect()] == [1.0]
    (tmp_path / "data" / "catch c_33.csv").write_text(HEADER_A + ROW_C.replace(",1\n", ",42\n"))
    assert [r["measurement_value"] for r in again(published).select(lists).filtered.collect()] == [42.0]


def test_only_the_results_used_last_are_indexed(published):
    kept = published.kept()
    kept.most = 2
    for year in (1990, 1991, 2012):
        kept.keep(Selection(year=(year,)))
    assert kept.source(Selection(year=(1990,))) is None and kept.source(Selection(year=(2012,))) is not None


def test_going_back_to_the_last_polygon(published):
    first = published.default()
    second = published.select(first.selection.with_values(polygon="POLYGON ((39 9,46 9,46 16,39 16,39 9))"), first)
    third = published.select(second.selection.with_values(year=(2012,)), second)
    assert third.last_polygon == first.selection.polygon
    back = published.last_polygon(third)
    assert back.selection.polygon == first.selection.polygon and back.selection.year == (2012,)
    assert {r["codesource_area"] for r in back.filtered.collect()} == {"100"}
    assert published.last_polygon(first).selection.polygon is None


def test_a_free_drawing_selects_what_it_touches(published):
    first = published.default()
    feature = '{"geometry":{"type":"Polygon","coordinates":[[[-1,-1],[-1,3],[2,3],[4,1],[2,-1],[-1,-1]]]}}'
    drawn = published.draw(feature, first)
    assert {r["codesource_area"] for r in drawn.filtered.collect()} == {"100"}
    hole = '{"geometry":{"type":"Polygon","coordinates":[[[-9,-9],[-9,9],[9,9],[9,-9],[-9,-9]],[[-1,-1],[2,-1],[2,2],[-1,2],[-1,-1]]]}}'
    assert published.draw(hole, first) is None
    with pytest.raises(ValueError):
        published.draw('{"geometry":{"type":"Point","coordinates":[1,2]}}', first)
