import zipfile

import pytest
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions import scalars as X
from gridcompare.operators import ingest as I
from gridcompare.sources import files, jdbc

LAYOUT_A = ["source_authority", "fishing_fleet", "time_start", "time_end", "geographic_identifier", "gear_type", "species",
            "fishing_mode", "measurement_unit", "measurement_value"]
LAYOUT_B = ["source_authority", "flag", "time_start", "time_end", "codesource_area", "gear", "species", "schooltype_label",
            "catchunit", "value", "extra"]
LAYOUT_C = ["source_authority", "fishingfleet", "time_start", "time_end", "geographic_identifier", "gear", "species",
            "schooltype", "unit", "value"]
ROW = ("IOTC", "EUFRA", "2011-03-01", "2011-03-31", "6100101", "01.1", "YFT", "FS", "MT", "12.5")


@pytest.mark.parametrize("columns", [LAYOUT_A, LAYOUT_B, LAYOUT_C])
def test_layouts_become_one(spark, columns):
    row = ROW + ("x",) * (len(columns) - len(ROW))
    raw = spark.createDataFrame([row], columns)
    out = I.harmonise(raw, "d1")
    assert out.columns == [*S.OBSERVATION_COLUMNS, "dataset"]
    assert tuple(out.first()) == ROW + ("d1",)
    assert {t for _, t in out.dtypes} == {"string"}


def test_unknown_layout_is_refused(spark):
    with pytest.raises(I.UnknownLayout, match="fishing_mode"):
        I.harmonise(spark.createDataFrame([("a",)], "source_authority string"), "d")


def test_column_names_are_matched_whole():
    columns = [c for c in LAYOUT_A] + ["flagship_vessel"]
    assert I.canonical_names(columns) == {"geographic_identifier": "codesource_area"}


def test_numeric_area_codes_become_text(spark):
    raw = spark.createDataFrame([ROW], LAYOUT_A).withColumn("geographic_identifier", F.lit(610).cast("int"))
    assert I.harmonise(raw, "d").first()["codesource_area"] == "610"


def test_typed_observations(spark):
    rows = [ROW, ROW[:-2] + ("Tons", "abc"), ROW[:2] + ("bad date",) + ROW[3:-2] + ("HOOKS", None)]
    out = I.typed_observations(I.harmonise(spark.createDataFrame(rows, LAYOUT_A), "d"))
    got = [(r["measurement_unit"], r["measurement_value"], r["year"]) for r in out.collect()]
    assert got == [("t", 12.5, 2011), ("t", None, 2011), ("HOOKS", None, None)]
    assert sorted(out.columns) == sorted(S.FACT_SCHEMA.names)


def test_units_are_case_sensitive_and_stable(spark):
    df = spark.createDataFrame([("Tons",), ("tons",), ("MT",), ("NO",), ("Number of fish",), ("no",), ("kg",), (None,)], "u string")
    once = df.select(X.normalise_unit("u").alias("u"))
    expected = ["t", "tons", "t", "no", "no", "no", "kg", None]
    assert [r["u"] for r in once.collect()] == expected
    assert [r["u"] for r in once.select(X.normalise_unit("u").alias("u")).collect()] == expected


@pytest.mark.parametrize("text, value", [("2011", 2011), ("2011-06", 2011), ("2011-06-01", 2011), ("x", None), (None, None)])
def test_year_of_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.year_of("t")).first()[0] == value


# ---- manifest


def test_manifest(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("DOI,Filename\n10.5281/zenodo.17,some_catch.v2.zip\n10.5281/zenodo.18,csv_catch.csv\n")
    manifest = files.read_manifest(spark, str(path))
    assert manifest.columns == ["DOI", "Filename", "identifier", "title"]
    derived = I.derive_manifest(manifest)
    rows = {r["record_id"]: r for r in derived.collect()}
    assert rows["17"]["filename"] == "some_catch" and rows["17"]["file_mime"] == "zip"
    assert rows["17"]["newname"] == "some_catch_17.zip"
    assert rows["18"]["url"] == "https://doi.org/10.5281/zenodo.18"
    records = spark.createDataFrame([("17", "urn:Title urn:x", None)], "record_id string, title string, identifier string")
    enriched = {r["record_id"]: (r["title"], r["identifier"]) for r in I.enrich_manifest(derived, records).collect()}
    assert enriched == {"17": ("Title x", ""), "18": ("", "")}


@pytest.mark.parametrize(
    "path, dataset",
    [("/data/catch_17.csv", "catch_17"), ("catch_17.zip", "catch_17"), ("/a/csv_catch_18.qs", "csv_catch_18"), ("/a/x_csv_y.csv", "x_csv_y")],
)
def test_dataset_of_path(spark, path, dataset):
    assert spark.range(1).select(I.dataset_of_path(F.lit(path))).first()[0] == dataset


# ---- files

CSV = 'source_authority,flag,value,note\nIOTC,NA,1.5,"a, ""b"""\n"ICCAT",,NA,\n'
EXPECTED = [("IOTC", None, "1.5", 'a, "b"'), ("ICCAT", "", None, "")]


def test_csv_reader_tells_missing_from_blank(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text(CSV)
    raw = files.read_observations_csv(spark, str(path), files.csv_columns(spark, str(path)))
    assert {t for _, t in raw.dtypes} == {"string"}
    assert [tuple(r) for r in raw.collect()] == EXPECTED


QUOTED = 'a,b,c\n1,"he said ""hi"", ok",x\n2,"two\nlines",y\n'


def test_quotes_commas_and_line_breaks_are_the_same_in_csv_and_zip(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(QUOTED)
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as archive:
        archive.writestr("q.csv", QUOTED)
    zipped = [tuple(r) for r in files.read_observations_zip(spark, str(tmp_path / "q.zip")).collect()]
    assert zipped == [("1", 'he said "hi", ok', "x"), ("2", "two\nlines", "y")]
    columns = files.csv_columns(spark, str(path))
    plain = files.read_observations_csv(spark, str(path), columns, multiline=True)
    assert [tuple(r) for r in plain.collect()] == zipped
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_observations_csv(spark, str(path), columns).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_observations_csv(spark, str(path), columns).select("a").collect()


def test_dataset_from_file_name(spark, tmp_path):
    for name in ("one_1.csv", "two + 3%_2.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    raw = files.with_file_provenance(files.read_observations_csv(spark, str(tmp_path), ["a", "b"]))
    assert {r["dataset"] for r in raw.collect()} == {"one_1", "two + 3%_2"}


def test_zip_reader(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "obs.zip", "w") as archive:
        archive.writestr("readme.txt", "nothing")
        archive.writestr("folder/obs.csv", CSV)
    raw = files.read_observations_zip(spark, str(tmp_path / "obs.zip"))
    assert raw.columns == ["source_authority", "flag", "value", "note"]
    assert [tuple(r) for r in raw.collect()] == EXPECTED


def test_zip_without_its_csv_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "obs.zip", "w") as archive:
        archive.writestr("other.csv", CSV)
    with pytest.raises(Exception, match="obs.csv"):
        files.read_observations_zip(spark, str(tmp_path / "obs.zip"))


def test_code_list_with_repeated_header_and_stray_text(spark, tmp_path):
    path = tmp_path / "units.csv"
    path.write_text(
        '"code","label","fr","es","group","group","link"\n'
        '"A","Number of boats",NA,NA,effort,,\n'
        '"B","Not available"  (to be merged ??),NA,NA,effort,,"-none-" ??\n'
        '"C",NA,NA,NA,effort,time,\n'
    )
    units = files.read_codelist(spark, str(path))
    assert units.columns == ["code", "label", "fr", "es", "group4", "group5", "link"]
    labels = {r["code"]: r["label"] for r in units.collect()}
    assert labels["A"] == "Number of boats" and labels["C"] is None
    assert labels["B"].startswith('"Not available"') and len(labels) == 3


def test_area_lists(spark, tmp_path):
    (tmp_path / "grid.csv").write_text('code,GRIDTYPE,geom_wkt,more\n007,1deg_x_1deg,"POLYGON ((0 0,1 0,1 1,0 0))",x\n')
    row = files.read_grid_areas(spark, str(tmp_path / "grid.csv")).first()
    assert tuple(row) == ("007", "1deg_x_1deg", "POLYGON ((0 0,1 0,1 1,0 0))")
    (tmp_path / "nominal.csv").write_text('code,geom_wkt\nN1,"POLYGON ((0 0,1 0,1 1,0 0))"\n')
    assert files.read_nominal_areas(spark, str(tmp_path / "nominal.csv")).columns == ["code", "geom_wkt"]


def test_database_options():
    env = {"DB_HOST": "h", "DB_PORT": "5433", "DB_NAME": "n", "DB_USER_READONLY": "u", "DB_PASSWORD": "p"}
    options = jdbc.connection_options(env)
    assert options["url"] == "jdbc:postgresql://h:5433/n" and options["user"] == "u"
    query = jdbc.fact_query("public.facts")
    assert query.startswith("(SELECT ogc_fid, dataset") and "source_authority" in query
    assert query.endswith("ST_AsText(ST_GeometryN(geom, 1)) AS geom FROM public.facts) AS fact")
    assert jdbc.partition_options(1, 100, 4)["upperBound"] == "101"
