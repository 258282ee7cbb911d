"""Readers of published files: manifest, observations (CSV, zipped CSV, parquet), code and area lists."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.operators.ingest import dataset_of_path

ZIP_ROWS_PER_BATCH = 50_000


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``DOI,Filename`` with empty title and identifier, to be filled by the records."""
    manifest = spark.read.schema(S.MANIFEST_SCHEMA).csv(path, header=True)
    return manifest.withColumns({"identifier": F.lit(""), "title": F.lit("")})


def _as_published(text: DataFrame) -> DataFrame:
    """The text ``NA`` is missing, a blank field is an empty text."""
    return text.select(
        *[F.when(F.col(f"`{c}`") == "NA", None).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in text.columns]
    )


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: its first line, read by the driver without a job."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return next(csv.reader([(line or "").removeprefix("\ufeff")]))


def read_observations_csv(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], multiline: bool = False
) -> DataFrame:
    """Raw observations with these ``columns`` (see ``csv_columns``), every column text.

    Quotes inside a field are doubled, as in a zip archive's CSV. Files are split into tasks by Spark; a file with
    line breaks inside fields needs ``multiline``, which reads it in one task. A row that does not fit the columns,
    such as one cut by a line break in a field, ends the read with an error.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
    reader = reader.option("multiLine", multiline).option("mode", "FAILFAST").option("columnPruning", False)
    return _as_published(reader.csv(path if isinstance(path, str) else list(path)))


def with_file_provenance(raw: DataFrame) -> DataFrame:
    """Add ``dataset`` from the name of the file each row was read from (call it right after the reader)."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))  # a plus sign is not encoded there
    return raw.withColumn("dataset", dataset_of_path(F.url_decode(encoded)))


def _csv_member(archive: zipfile.ZipFile, path: str) -> str:
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0]
    wanted = f"{stem}.csv"
    for name in archive.namelist():
        if name.rsplit("/", 1)[-1] == wanted:
            return name
    raise FileNotFoundError(f"{wanted} is not in {path}")


def _open(path: str):
    """A file for reading where it is, at any place of it; not loaded as a whole."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    uri = f"{scheme}://{quote(rest)}" if not rest.startswith("//") else f"{scheme}:{quote(rest)}"
    system, place = fs.FileSystem.from_uri(uri)
    return system.open_input_file(place)


def _zip_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(_csv_member(archive, path)) as raw:
                header = next(csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")))
            yield pd.DataFrame({"header": [header]})


def _zip_rows(columns: Sequence[str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(_csv_member(archive, path)) as raw:
                    chunks = pd.read_csv(
                        raw,
                        dtype=str,
                        keep_default_na=False,
                        na_values=["NA"],
                        encoding="utf-8-sig",
                        chunksize=ZIP_ROWS_PER_BATCH,
                    )
                    for chunk in chunks:
                        yield chunk[list(columns)].astype(object).where(chunk[list(columns)].notna(), None)

    return rows


def read_observations_zip(spark: SparkSession, path: str) -> DataFrame:
    """Raw observations of the CSV file inside a zip archive (the member with the archive's name).

    An archive cannot be split, so each one is read by one task, as a stream and in batches, whatever its size.
    Store the result once as parquet before querying it. All archives of ``path`` must share their columns.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")  # names only, no content is loaded
    header = archives.limit(1).mapInPandas(_zip_header, "header array<string>").first()["header"]
    fields = ", ".join(f"`{c}` string" for c in header)
    return archives.mapInPandas(_zip_rows(header), fields)


def read_parquet_fact(spark: SparkSession, path: str) -> DataFrame:
    """A stored fact with the canonical schema."""
    return spark.read.schema(S.FACT_SCHEMA).parquet(path)


def read_codelist(spark: SparkSession, path: str) -> DataFrame:
    """Any code list. Empty and ``NA`` are missing; a repeated column name gets its position appended. Fields may
    hold doubled quotes and line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="NA", escape='"', multiLine=True)


def read_grid_areas(spark: SparkSession, path: str) -> DataFrame:
    return read_codelist(spark, path).select("code", "GRIDTYPE", "geom_wkt")


def read_nominal_areas(spark: SparkSession, path: str) -> DataFrame:
    return read_codelist(spark, path).select("code", "geom_wkt")
