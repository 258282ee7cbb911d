"""Manifest derivation and harmonisation of raw observation files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions import scalars as X
from gridcompare.functions.exact_sum import exact_sums


class UnknownLayout(ValueError):
    """A raw file lacks canonical columns after every known renaming."""


# ---------------------------------------------------------------------------------------------
# Manifest


def derive_manifest(manifest: DataFrame) -> DataFrame:
    """Record id, file stem, extension, dataset code, new file name, link and badge of each published file."""
    doi, filename = F.col("DOI"), F.col("Filename")
    url = F.concat(F.lit("https://doi.org/"), doi)
    parts = manifest.select(
        doi.alias("doi"),
        filename.alias("source_filename"),
        F.regexp_replace(doi, r".*\.", "").alias("record_id"),
        F.regexp_replace(filename, r"\..*", "").alias("filename"),
        F.regexp_replace(filename, r".*\.", "").alias("file_mime"),
        url.alias("url"),
        F.concat(F.lit("[![DOI](https://zenodo.org/badge/DOI/"), doi, F.lit(".svg)]("), url, F.lit(")")).alias("badge"),
    )
    code = F.concat_ws("_", "filename", "record_id")
    return parts.withColumn("code", code).withColumn("newname", F.concat_ws(".", "code", "file_mime"))


def enrich_manifest(derived: DataFrame, records: DataFrame) -> DataFrame:
    """Add title and identifier of each record; a record without them keeps empty text."""
    details = records.select(
        "record_id", X.drop_urn("title").alias("title"), X.drop_urn("identifier").alias("identifier")
    )
    return derived.join(details, "record_id", "left").fillna("", ["title", "identifier"])


def manifest_table(enriched: DataFrame) -> DataFrame:
    """The columns shown to a reader."""
    return enriched.select("identifier", "title", "doi", F.col("source_filename").alias("filename"), "url")


def dataset_of_path(path: str | Column) -> Column:
    """Dataset name of a stored file: its name without folder and extension."""
    return X.drop_dataset_extension(X.base_name(path))


# ---------------------------------------------------------------------------------------------
# Observations


def canonical_names(columns: Iterable[str]) -> dict[str, str]:
    """Renaming that brings the columns of one published file to the canonical names."""
    columns = set(columns)
    renames = {old: new for old, new in S.AREA_ALIAS.items() if old in columns}
    for marker, aliases in S.LAYOUT_ALIASES.items():
        if marker in columns:
            renames |= aliases
    result = {renames.get(c, c) for c in columns}
    missing = [c for c in S.OBSERVATION_COLUMNS if c not in result]
    if missing:
        raise UnknownLayout(f"no column for {', '.join(missing)} among {', '.join(sorted(columns))}")
    return renames


def harmonise(raw: DataFrame, dataset: str | Column) -> DataFrame:
    """One published file in canonical columns, all text, with the dataset it comes from."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    renamed = raw.withColumnsRenamed(canonical_names(raw.columns))
    return renamed.select(*[F.col(c).cast("string").alias(c) for c in S.OBSERVATION_COLUMNS], dataset.alias("dataset"))


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def typed_observations(harmonised: DataFrame) -> DataFrame:
    """Unit spellings unified, the measure as a number, the year taken from the start date."""
    return harmonised.select(
        *[c for c in S.OBSERVATION_COLUMNS if not c.startswith("measurement_")],
        X.normalise_unit("measurement_unit").alias("measurement_unit"),
        X.lenient_double("measurement_value").alias("measurement_value"),
        "dataset",
        X.year_of("time_start").alias("year"),
    )


# ---------------------------------------------------------------------------------------------
# Reports on the raw text


def rows_per_dataset(facts: DataFrame) -> DataFrame:
    return facts.groupBy("dataset").agg(F.count(F.lit(1)).alias("count"))


def rows_per_year(harmonised: DataFrame) -> DataFrame:
    return harmonised.groupBy("dataset", X.year_of("time_start").alias("year")).agg(F.count(F.lit(1)).alias("count"))


def unit_spellings(harmonised: DataFrame) -> DataFrame:
    """How each unit text was read."""
    counted = harmonised.groupBy(F.col("measurement_unit").alias("raw_unit")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("raw_unit", X.normalise_unit("raw_unit").alias("unit"), "count")


def measure_quality(harmonised: DataFrame) -> DataFrame:
    """Rows, readable measures and their sum per dataset."""
    read = harmonised.withColumn("total", X.lenient_double("measurement_value"))
    return exact_sums(read, ["dataset"], "total", n_rows=F.count(F.lit(1)), n_valid=F.count("total"))


def rows_with_area(facts: DataFrame) -> DataFrame:
    return rows_per_dataset(facts.where(F.col("codesource_area").isNotNull()))
