"""Published files on shared storage: from the manifest to the tables that selections use."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridcompare.operators import areas as A
from gridcompare.operators import facets as FA
from gridcompare.operators import grouped as GR
from gridcompare.operators import ingest as I
from gridcompare.operators import spatial as SP
from gridcompare.operators.selection import (
    Selection,
    SelectionResult,
    apply_selection,
    next_selection,
    recognise_reset,
)
from gridcompare.sources import files
from gridcompare.sources.stored import StoredTables, materialise, materialise_parts


@dataclass(frozen=True)
class Inputs:
    """Where the published files are.

    ``codelists`` maps a dimension to its code list; ``records`` is a CSV ``record_id,title,identifier``.
    """

    manifest: str
    data_dir: str
    grid_areas: str
    nominal_areas: str
    codelists: Mapping[str, str] = field(default_factory=dict)
    records: str | None = None
    multiline: bool = False  # fields of the CSV files may hold line breaks


class PublishedFiles(StoredTables):
    """Facts, areas, facets and selections of the datasets named in a manifest."""

    def __init__(self, spark: SparkSession, inputs: Inputs):
        self.spark = spark
        self.inputs = inputs

    # -- manifest -----------------------------------------------------------------------------

    def manifest(self) -> DataFrame:
        """The manifest with derived columns, and with titles and identifiers where they are known."""
        derived = I.derive_manifest(files.read_manifest(self.spark, self.inputs.manifest))
        if self.inputs.records is None:
            return derived
        return I.enrich_manifest(derived, files.read_codelist(self.spark, self.inputs.records))

    @cached_property
    def _published(self) -> list[Row]:
        """One row per published file. Each names a file to open, so the list is needed to build the plan."""
        derived = I.derive_manifest(files.read_manifest(self.spark, self.inputs.manifest))
        return derived.select("code", "source_filename", "file_mime", "newname").collect()

    def _path(self, entry: Row) -> str:
        """CSV files are stored under their new name, archives under their own; any other format is expected
        as parquet under the dataset's code."""
        name = {"csv": entry["newname"], "zip": entry["source_filename"]}.get(entry["file_mime"], f"{entry['code']}.parquet")
        return f"{self.inputs.data_dir.rstrip('/')}/{name}"

    def _unsplit(self, entry: Row) -> DataFrame:
        """Observations of one file that is not CSV; an archive is unpacked once."""
        path = self._path(entry)
        if entry["file_mime"] != "zip":
            return self.spark.read.parquet(path)
        return materialise(
            self.spark, f"unzipped_{entry['code']}", [path], lambda: files.read_observations_zip(self.spark, path)
        )

    # -- facts and areas ------------------------------------------------------------------------

    def fact_inputs(self) -> list[str]:
        return [self.inputs.manifest, *map(self._path, self._published)]

    def area_inputs(self) -> list[str]:
        return [self.inputs.grid_areas, self.inputs.nominal_areas, *self.fact_inputs()]

    def harmonised(self, datasets: Collection[str] | None = None) -> DataFrame:
        """All observations, or those of some datasets, in canonical columns, as text.

        CSV files with the same columns are read by one scan, so the plan grows with the number of layouts
        and not with the number of files.
        """
        by_columns: dict[tuple[str, ...], list[str]] = {}
        frames = []
        for entry in self._published:
            if datasets is not None and entry["code"] not in datasets:
                continue
            if entry["file_mime"] == "csv":
                path = self._path(entry)
                by_columns.setdefault(tuple(files.csv_columns(self.spark, path)), []).append(path)
            else:
                frames.append(I.harmonise(self._unsplit(entry), entry["code"]))
        for columns, paths in by_columns.items():
            raw = files.with_file_provenance(
                files.read_observations_csv(self.spark, paths, columns, self.inputs.multiline)
            )
            frames.append(I.harmonise(raw, F.col("dataset")))
        return I.stack(frames)

    def _files(self) -> dict[str, list[str]]:
        """The files of each dataset. Only these are read anew when they change."""
        parts: dict[str, list[str]] = {}
        for entry in self._published:
            parts.setdefault(entry["code"], []).append(self._path(entry))
        return parts

    def facts(self) -> DataFrame:
        """The typed fact, stored on first use dataset by dataset. A dataset that is new or whose file has changed is
        read; the others stay as they are stored."""
        build = lambda datasets: I.typed_observations(self.harmonised(datasets))
        return materialise_parts(self.spark, "facts", self._files(), build, "dataset")

    def _area_lists(self) -> tuple[DataFrame, DataFrame]:
        grid = A.grid_areas(files.read_grid_areas(self.spark, self.inputs.grid_areas))
        return grid, A.nominal_areas(files.read_nominal_areas(self.spark, self.inputs.nominal_areas))

    def build_areas(self) -> DataFrame:
        """Grid areas that occur in the facts, and all nominal areas. The codes of each dataset are stored, so a
        change reads the codes of the others and not their observations."""
        codes = lambda datasets: self.facts().where(F.col("dataset").isin(datasets)).select("dataset", "codesource_area").distinct()
        used = materialise_parts(self.spark, "used_areas", self._files(), codes, "dataset")
        grid, nominal = self._area_lists()
        return A.numbered(A.area_dimension(A.used_by(grid, used), nominal))

    def grouped(self) -> DataFrame:
        """The grouped fact, stored on first use dataset by dataset, each sorted by unit, species and year. A group
        belongs to one dataset, and the grid type of an area to its code, so the parts are those of the whole."""
        self.areas()  # checks that no area code is listed twice
        lists = [self.inputs.grid_areas, self.inputs.nominal_areas]
        parts = {code: [*paths, *lists] for code, paths in self._files().items()}

        def build(datasets: list[str]) -> DataFrame:
            return GR.grouped_fact(self.facts().where(F.col("dataset").isin(datasets)), A.area_dimension(*self._area_lists()))

        return materialise_parts(self.spark, "grouped", parts, build, "dataset", ["measurement_unit", "species", "year"])

    def combinations(self) -> DataFrame:
        """The facet combinations, stored on first use dataset by dataset."""
        lists = [self.inputs.grid_areas, self.inputs.nominal_areas]
        parts = {code: [*paths, *lists] for code, paths in self._files().items()}
        build = lambda datasets: GR.facet_combinations(self.grouped().where(F.col("dataset").isin(datasets)))
        return materialise_parts(self.spark, "combinations", parts, build, "dataset")

    # -- facets and selections --------------------------------------------------------------------

    def codelists(self) -> dict[str, DataFrame]:
        return {name: files.read_codelist(self.spark, path) for name, path in self.inputs.codelists.items()}

    def facets(self) -> DataFrame:
        """``(dimension, code, label, sort_label, pos)`` of everything a user can choose, in display order by ``pos``."""
        return FA.ordered_labels(FA.facet_labels(self.values(), self.codelists()))

    def datasets(self) -> DataFrame:
        """The dataset list with titles, identifiers and links."""
        return FA.dataset_facet(FA.values_of(self.values(), "dataset"), self.manifest())

    def select(self, selection: Selection, previous: SelectionResult | None = None) -> SelectionResult:
        """Apply a selection. Lists that hold every value are a reset. What no kept result holds is read from the
        fact and kept, so that narrower selections read that."""
        selection = recognise_reset(selection, self.values())
        grouped, areas, kept = self.grouped(), self.areas(), self.kept()
        if previous is None:
            result = apply_selection(grouped, areas, selection, None, True, kept)
        else:
            result, _ = next_selection(grouped, areas, previous, selection, True, kept)
        lists = result.effective.without_polygon()
        if not lists.is_reset and kept.source(lists) is None:
            result = result.keep()
        return result

    def last_polygon(self, result: SelectionResult) -> SelectionResult:
        """Go back to the polygon that was in use before the present one."""
        return self.select(result.with_last_polygon(), result)

    def draw(self, feature: str, previous: SelectionResult) -> SelectionResult | None:
        """Apply a drawn polygon (GeoJSON Polygon or MultiPolygon of any shape, holes included) to the previous
        selection. None when it shares no point with the areas shown, so there is nothing to select."""
        drawn = SP.drawn_polygons(self.spark.createDataFrame([(feature,)], "feature string"))
        shape = drawn.first()["wkt"]
        if shape is None:
            raise ValueError("a drawing must be a Polygon or MultiPolygon with closed rings")
        if not SP.disjoint_polygons(drawn, previous.footprint).isEmpty():
            return None
        return self.select(previous.selection.with_values(polygon=shape), previous)

    def default(self) -> SelectionResult:
        """The default selection; its rows are stored on first use."""
        result = self.select(Selection.default())
        inputs = self.fact_inputs() + self.area_inputs()
        return result.read_from(materialise(self.spark, "default_selection", inputs, lambda: result.filtered))
