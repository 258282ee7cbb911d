"""Fact rows from a PostgreSQL table."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridcompare.sources.stored import materialise

# The projected columns of the published catch table.
FACT_COLUMNS = (
    "ogc_fid",
    "dataset",
    "year",
    "month",
    "source_authority",
    "species",
    "fishing_fleet",
    "gear_type",
    "measurement_value",
    "measurement_unit",
    "count",
    "gridtype",
    "fishing_mode",
    "codesource_area",
    "geom_id",
)
# Fixed value: the first polygon of a geometry as text, in the database's own functions.
FIRST_PART = "ST_AsText(ST_GeometryN(geom, 1)) AS geom"


def fact_query(table: str) -> str:
    """Subquery with only the needed columns and the first polygon of each geometry as text."""
    return f"(SELECT {', '.join(FACT_COLUMNS)}, {FIRST_PART} FROM {table}) AS fact"


def connection_options(env: Mapping[str, str]) -> dict[str, str]:
    """JDBC options from ``DB_HOST, DB_PORT, DB_NAME, DB_USER_READONLY, DB_PASSWORD``."""
    url = f"jdbc:postgresql://{env['DB_HOST']}:{env.get('DB_PORT', '5432')}/{env['DB_NAME']}"
    return {
        "url": url,
        "user": env["DB_USER_READONLY"],
        "password": env["DB_PASSWORD"],
        "driver": "org.postgresql.Driver",
    }


def partition_options(first_id: int, last_id: int, partitions: int, fetch_rows: int = 10_000) -> dict[str, str]:
    """Parallel read in ranges of the row id, which spreads rows evenly whatever years or areas are hot."""
    return {
        "partitionColumn": "ogc_fid",
        "lowerBound": str(first_id),
        "upperBound": str(last_id + 1),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_rows),
    }


def read_fact(spark: SparkSession, env: Mapping[str, str], table: str, partitions: int = 64) -> DataFrame:
    """Read the table in parallel. Only the smallest and largest row id are fetched beforehand."""
    reader = spark.read.format("jdbc").options(**connection_options(env))
    bounds = reader.option("dbtable", f"(SELECT min(ogc_fid) AS a, max(ogc_fid) AS b FROM {table}) AS bounds").load().first()
    reader = spark.read.format("jdbc").options(**connection_options(env)).option("dbtable", fact_query(table))
    if bounds["a"] is not None:
        reader = reader.options(**partition_options(int(bounds["a"]), int(bounds["b"]), partitions))
    return reader.load()


def stored_fact(spark: SparkSession, env: Mapping[str, str], version: str, table: str, partitions: int = 64) -> DataFrame:
    """The table as stored parquet, fetched from the database on first use of ``version``. Databases and tables
    are told apart."""
    source = f"{connection_options(env)['url']}\n{fact_query(table)}"
    key = f"{version}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    return materialise(spark, "database_fact", [], lambda: read_fact(spark, env, table, partitions), version=key)
